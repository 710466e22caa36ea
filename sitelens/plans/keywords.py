"""Keyword reports over search metrics: project_id, keyword_id, date, clicks, impressions, position, page_url, source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import blank, utrim

BIG = "decimal(28,6)"


def _weighted() -> Column:
    """Position weighted by impressions; the plain mean where there are none."""
    shown = F.sum("impressions")
    return F.when(shown == 0, F.avg(F.col("position").cast("decimal(18,6)"))).otherwise(F.sum(F.col("position").cast("decimal(18,6)") * F.col("impressions")).cast(BIG) / F.nullif(shown, F.lit(0)))


def keyword_history(metrics: DataFrame, days: int = 14) -> DataFrame:
    """Position, impressions and clicks by keyword and date, the last ``days`` dates."""
    points = metrics.groupBy("project_id", "keyword_id", "date").agg(F.bround(_weighted(), 2).cast("decimal(10,2)").alias("position"), F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"))
    latest = W.partitionBy("project_id", "keyword_id").orderBy(F.desc("date"))
    return points.withColumn("back", F.row_number().over(latest)).filter(F.col("back") <= days)


def keyword_overview(keywords: DataFrame, metrics: DataFrame) -> DataFrame:
    """Totals, best page, latest source, current and previous position and trend of every keyword."""
    key = ["project_id", "keyword_id"]
    shown = F.sum("impressions")
    totals = metrics.groupBy(*key).agg(
        F.sum("clicks").alias("clicks"),
        shown.alias("impressions"),
        F.bround(F.coalesce(F.sum("clicks").cast(BIG) / F.nullif(shown, F.lit(0)), F.lit(0)), 4).cast("decimal(10,4)").alias("ctr"),
        F.bround(F.coalesce(F.sum(F.col("position").cast("decimal(18,6)") * F.col("impressions")).cast(BIG) / F.nullif(shown, F.lit(0)), F.lit(0)), 2).cast("decimal(10,2)").alias("position"),
        F.min(F.struct((-F.col("clicks")).alias("c"), "page_url")).alias("best"),
        F.max(F.struct("date", "source")).alias("newest"),
    )
    points = keyword_history(metrics, 2).groupBy(*key).agg(F.max(F.when(F.col("back") == 1, F.col("position"))).alias("current_position"), F.max(F.when(F.col("back") == 2, F.col("position"))).alias("previous_position"))
    delta = F.bround(F.col("previous_position") - F.col("current_position"), 1).cast("decimal(10,1)")
    trend = (
        F.when(F.col("current_position").isNull(), "stable").when(F.col("previous_position").isNull(), "new")
        .when(F.col("delta") > 0.5, "up").when(F.col("delta") < -0.5, "down").otherwise("stable")
    )
    rows = keywords.join(totals, key, "left").join(points, key, "left").withColumn("delta", delta)
    return rows.select(
        *key, "phrase", "is_tracked", "clicks", "impressions", "ctr", "position", F.col("best.page_url").alias("best_page"),
        F.coalesce("newest.source", F.lit("none")).alias("source"), "current_position", "previous_position", "delta", trend.alias("trend"),
    )


def keyword_opportunities(keywords: DataFrame, metrics: DataFrame) -> DataFrame:
    """Keywords on positions 4 to 15 with at least ten impressions, by score."""
    shown = F.sum("impressions")
    sums = metrics.groupBy("project_id", "keyword_id").agg(
        shown.alias("impressions"),
        F.sum("clicks").alias("clicks"),
        (F.sum(F.col("position").cast("decimal(18,6)") * F.col("impressions")).cast(BIG) / F.greatest(shown, F.lit(1))).cast(BIG).alias("average"),
        F.min(F.struct((-F.col("clicks")).alias("c"), "page_url")).alias("best"),
    )
    raw = 100 - (F.col("average") - 4) * 5 + F.least(F.lit(20), F.col("impressions").cast(BIG) / 100)
    score = F.floor(F.greatest(F.least(raw, F.lit(100)), F.lit(0))).cast("int")
    scored = sums.filter((F.col("average") >= 4) & (F.col("average") <= 15) & (F.col("impressions") >= 10)).withColumn("score", score).filter("score > 0")
    ctr = F.bround(F.coalesce(F.col("clicks").cast(BIG) / F.nullif(F.col("impressions"), F.lit(0)), F.lit(0)), 4).cast("decimal(10,4)")
    return scored.join(keywords.select("project_id", "keyword_id", "phrase"), ["project_id", "keyword_id"]).select(
        "project_id", "keyword_id", "phrase", "impressions", "clicks", ctr.alias("ctr"), F.bround("average", 2).cast("decimal(10,2)").alias("average"), F.col("best.page_url").alias("best_page"), "score"
    )


def keyword_cannibalization(keywords: DataFrame, metrics: DataFrame) -> DataFrame:
    """Keywords for which a second page takes at least 15 % of ten impressions or more."""
    key = ["project_id", "keyword_id"]
    pages = metrics.filter(~blank(F.col("page_url"))).groupBy(*key, utrim(F.col("page_url")).alias("page")).agg(
        F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"), F.bround(_weighted(), 1).cast("decimal(10,1)").alias("position")
    )
    pages = pages.filter("impressions > 0 or clicks > 0")
    order = W.partitionBy(*key).orderBy(F.desc("impressions"), "page")
    ranked = pages.withColumn("rank", F.row_number().over(order)).withColumn("total", F.sum("impressions").over(W.partitionBy(*key)))
    share = F.bround(F.col("impressions").cast(BIG) / F.nullif(F.col("total"), F.lit(0)) * 100, 1).cast("decimal(5,1)")
    grouped = ranked.withColumn("share", F.coalesce(share, F.lit(0))).groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.max("total").alias("total"),
        F.max(F.when(F.col("rank") == 2, F.col("impressions"))).alias("second"),
        F.max(F.when(F.col("rank") == 2, F.col("position"))).alias("second_position"),
        F.array_sort(F.collect_list(F.struct("rank", "page", "impressions", "clicks", "position", "share"))).alias("pages"),
    )
    second = F.col("second").cast(BIG) / F.col("total") * 100
    found = grouped.filter((F.col("n_pages") >= 2) & (F.col("total") >= 10)).withColumn("second_share", second).filter("second_share >= 15")
    severity = F.when((F.col("second_share") >= 30) & (F.col("second_position") <= 30), "High").otherwise("Medium")
    return found.join(keywords.select(*key, "phrase"), key).select(*key, "phrase", severity.alias("severity"), "n_pages", "total", F.bround("second_share", 1).cast("decimal(5,1)").alias("second_share"), "pages")


def keyword_summary(keywords: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row per project: tracked, in the top 3/10/20/100, improved, declined, cannibalised, totals."""
    overview = keyword_overview(keywords, metrics)
    tops = [F.count_if(F.col("current_position") <= n).alias(f"top_{n}") for n in (3, 10, 20, 100)]
    sums = overview.groupBy("project_id").agg(
        F.count_if("is_tracked").alias("tracked"), *tops, F.count_if(F.col("trend") == "up").alias("improved"), F.count_if(F.col("trend") == "down").alias("declined"),
        F.sum(F.coalesce("impressions", F.lit(0))).alias("impressions"), F.sum(F.coalesce("clicks", F.lit(0))).alias("clicks"),
    )
    clashes = keyword_cannibalization(keywords, metrics).groupBy("project_id").agg(F.count(F.lit(1)).alias("cannibalised"))
    return sums.join(clashes, "project_id", "left").fillna(0, ["cannibalised"])


def valid_metrics(metrics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows in their stored form, and rejected ones."""
    sound = F.coalesce((F.col("clicks") >= 0) & (F.col("impressions") >= 0) & (F.col("position") >= 0) & F.col("ctr").between(0, 1), F.lit(False))
    place = lambda c: F.when(blank(F.col(c)), "ALL").otherwise(F.upper(utrim(F.col(c))))
    stored = metrics.filter(sound).withColumns(
        {"ctr": F.bround(F.col("ctr").cast("decimal(18,10)"), 6).cast("decimal(7,6)"), "position": F.bround(F.col("position").cast("decimal(18,6)"), 2).cast("decimal(10,2)"), "country": place("country"), "device": place("device")}
    )
    return stored, metrics.filter(~sound)
