"""From rule results to issues, recommendations and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import CATEGORIES, severity_rank

# The most a rule can cost by severity, and the weight of a category.
PENALTIES = {"Notice": 2, "Low": 7, "Medium": 15, "High": 25, "Critical": 40}
WEIGHTS = {
    "Technical": "0.20", "Indexability": "0.15", "OnPage": "0.15", "Content": "0.15", "InternalLinks": "0.10",
    "StructuredData": "0.05", "Performance": "0.10", "International": "0.05", "Security": "0.05",
}
VERSION = "1.0"


def column_name(category: str) -> str:
    return "".join("_" + c.lower() if c.isupper() else c for c in category).lstrip("_")


def issues(results: DataFrame) -> DataFrame:
    """Open issues of the rules that fired."""
    return results.filter("triggered").select("crawl_id", "page_id", "code", "severity", "category", F.to_json("evidence").alias("evidence"), F.lit("Open").alias("status"))


def recommendations(found: DataFrame) -> DataFrame:
    """Priority, impact, effort and confidence of each issue."""
    by_severity = lambda values: F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col("severity"))
    return found.withColumns(
        {
            "priority": by_severity({"Critical": 95, "High": 82, "Medium": 65, "Low": 40, "Notice": 20}),
            "impact": by_severity({"Critical": "high", "High": "high", "Medium": "medium", "Low": "low", "Notice": "low"}),
            "effort": F.when(F.col("code").contains("CONTENT"), "medium").otherwise("low"),
            "confidence": F.when(F.col("severity") == "Critical", F.lit("0.98")).otherwise(F.lit("0.90")).cast("decimal(3,2)"),
        }
    )


def scores(results: DataFrame) -> DataFrame:
    """One row per crawl: overall, nine category scores (null where nothing was evaluated), is_partial, version."""
    rank = F.when(F.col("triggered"), severity_rank(F.col("severity")))
    per_code = results.groupBy("crawl_id", "category", "code").agg(F.max(rank).alias("rank"), F.count_if("triggered").alias("fired"), F.count(F.lit(1)).alias("total"))
    most = F.element_at(F.array(*[F.lit(p) for p in PENALTIES.values()]), F.col("rank").cast("int")).cast("decimal(5,0)")
    cost = F.coalesce(most * F.col("fired").cast("decimal(18,0)") / F.col("total").cast("decimal(18,0)"), F.lit(0)).cast("decimal(18,8)")
    category = per_code.groupBy("crawl_id", "category").agg(F.round(F.greatest(F.lit(0), 100 - F.sum(cost)), 1).cast("decimal(5,1)").alias("score"))
    wide = category.groupBy("crawl_id").pivot("category", CATEGORIES).agg(F.first("score"))
    weighted, weights = F.lit(0).cast("decimal(10,4)"), F.lit(0).cast("decimal(10,2)")
    for name, weight in WEIGHTS.items():
        w = F.lit(weight).cast("decimal(3,2)")
        weighted = weighted + F.coalesce(F.col(name) * w, F.lit(0))
        weights = weights + F.when(F.col(name).isNotNull(), w).otherwise(F.lit(0))
    covered: Column = sum((F.col(c).isNotNull().cast("int") for c in CATEGORIES), F.lit(0))
    overall = F.when(weights > 0, F.round((weighted / F.nullif(weights, F.lit(0))).cast("decimal(18,8)"), 1)).cast("decimal(5,1)")
    return wide.select("crawl_id", overall.alias("overall"), *[F.col(c).alias(column_name(c)) for c in CATEGORIES], (covered < len(CATEGORIES)).alias("is_partial"), F.lit(VERSION).alias("version"))
