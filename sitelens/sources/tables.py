"""Evidence tables: fixed schemas for reading, idempotent writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import csv_safe

_ASSET = "STRUCT<type STRING,url STRING,alt STRING,external BOOLEAN,mixed BOOLEAN,width STRING,height STRING,is_async BOOLEAN,is_defer BOOLEAN,loading STRING,media STRING,title STRING>"
_HOP = "STRUCT<from_url STRING,to_url STRING,status INT,duration_ms BIGINT>"
SCHEMAS = {
    "raw_page": f"crawl_id STRING, requested_url STRING, final_url STRING, status INT, content_type STRING, headers MAP<STRING,ARRAY<STRING>>, html STRING, duration_ms BIGINT, redirects ARRAY<{_HOP}>, depth INT",
    "crawled_url": f"id STRING, crawl_id STRING, project_id STRING, url STRING, canonical_url STRING, status INT, content_type STRING, depth INT, response_ms BIGINT, is_indexable BOOLEAN, word_count INT, content_hash STRING, redirects ARRAY<{_HOP}>, headers MAP<STRING,ARRAY<STRING>>",
    "page_snapshot": f"id STRING, crawled_url_id STRING, crawl_id STRING, title STRING, meta_description STRING, h1 STRING, headings ARRAY<STRUCT<level INT,text STRING>>, canonical STRING, robots_meta STRING, language STRING, json_ld ARRAY<STRING>, text STRING, image_count INT, missing_alt_count INT, internal_links INT, external_links INT, hreflang ARRAY<STRUCT<language STRING,target STRING>>, open_graph MAP<STRING,STRING>, twitter MAP<STRING,STRING>, x_robots STRING, assets ARRAY<{_ASSET}>",
    "page_link": "id STRING, crawl_id STRING, source_id STRING, target_url STRING, normalized_target STRING, anchor STRING, rel STRING, is_internal BOOLEAN, is_nofollow BOOLEAN",
    "keyword": "id STRING, project_id STRING, phrase STRING, normalized_phrase STRING, language STRING, country STRING, is_tracked BOOLEAN, last_metric_at TIMESTAMP",
    "keyword_metric": "id STRING, project_id STRING, keyword_id STRING, date DATE, clicks INT, impressions INT, ctr DECIMAL(7,6), position DECIMAL(10,2), source STRING, page_url STRING, country STRING, device STRING",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "events": "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP, o_orderpriority STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP",
}


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A table with its fixed schema; nothing is inferred where one is known."""
    reader = spark.read
    if name in SCHEMAS:
        reader = reader.schema(SCHEMAS[name])
    return reader.parquet(f"{directory}/{name}.parquet")


def read_raw_pages(spark: SparkSession, path: str) -> DataFrame:
    """Raw pages as files, in place of a fetch step."""
    return spark.read.schema(SCHEMAS["raw_page"]).parquet(path)


def write_crawl_rows(rows: DataFrame, path: str, crawls: list, *more: str, spare: tuple[str, ...] = ()) -> None:
    """Replace what the table holds of the given crawls by ``rows``; other crawls stay as they are.

    The table is partitioned by crawl_id and the columns ``more``.  Partitions of
    these crawls that get no new rows are removed, even if ``rows`` is empty, but
    for those named in ``spare`` (as ``source=advisory``).
    """
    from ..plans.durable import partitions, remove

    spark = rows.sparkSession
    rows.filter(F.col("crawl_id").isin(crawls)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("crawl_id", *more).parquet(path)
    new = {"/".join(f"{c}={r[c]}" for c in ("crawl_id", *more)) for r in rows.select("crawl_id", *more).distinct().collect()}
    for crawl in crawls:
        for found in partitions(spark, f"{path}/crawl_id={crawl}" + "/*" * len(more)):
            name = "/".join(found.rstrip("/").split("/")[-1 - len(more) :])
            if name not in new and not any(part in spare for part in name.split("/")):
                remove(spark, found)


def report(crawls: DataFrame, scores: DataFrame, issues: DataFrame) -> DataFrame:
    """One row per issue of a crawl with the crawl's counters and score, worst first."""
    from ..operators.rules import severity_rank

    rows = issues.join(crawls, "crawl_id").join(scores, "crawl_id", "left")
    return rows.orderBy("crawl_id", F.desc(severity_rank(F.col("severity"))), "code", "page_id")


def write_report(rows: DataFrame, path: str, kind: str) -> None:
    """JSON lines, or CSV with cells that no spreadsheet takes for formulas."""
    if kind == "json":
        rows.write.mode("overwrite").json(path)
    else:
        plain = rows.select(*[(csv_safe(F.col(c)) if t == "string" else F.col(c)).alias(c) for c, t in rows.dtypes])
        plain.write.mode("overwrite").option("header", True).csv(path)


def reports_list(reports: DataFrame) -> DataFrame:
    """Reports of each project, newest first."""
    return reports.orderBy("project_id", F.desc("created_at"), "id")
