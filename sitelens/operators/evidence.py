"""Page evidence: joining pages with snapshots, final addresses, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.urls import host, host_matches


def page_evidence(crawled: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Pages with their first snapshot (lowest id, of equal ids the lowest texts and numbers), the input of the rules; ``has_snapshot`` tells whether there is one."""
    ties = [c for c, t in snapshots.dtypes if c not in ("page_id", "snapshot_id") and not t.startswith(("array", "map", "struct"))]
    first = snapshots.withColumn("_k", F.row_number().over(W.partitionBy("page_id").orderBy("snapshot_id", *ties))).filter("_k = 1").drop("_k")
    return crawled.join(first.withColumn("_has", F.lit(True)), "page_id", "left").withColumn("has_snapshot", F.coalesce("_has", F.lit(False))).drop("_has")


def dedupe_final_urls(raw_pages: DataFrame) -> DataFrame:
    """One page for each crawl and final address; finals off the project's host or barred by robots go."""
    inside = raw_pages.filter(host_matches(host(F.col("final_url")), F.col("project_host")) & F.col("allowed"))
    order = W.partitionBy("crawl_id", "final_url").orderBy("depth", "page_id")
    return inside.withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_k")


def crawl_counters(discovered: DataFrame, pages: DataFrame) -> DataFrame:
    """Discovered, crawled and failed pages of each crawl."""
    found = discovered.groupBy("crawl_id").agg(F.count(F.lit(1)).alias("discovered"))
    done = pages.groupBy("crawl_id").agg(F.count(F.lit(1)).alias("crawled"), F.count_if(F.col("status") >= 400).alias("errors"))
    return found.join(done, "crawl_id", "full_outer").fillna(0, ["discovered", "crawled", "errors"])
