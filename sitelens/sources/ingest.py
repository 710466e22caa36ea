"""Ingesting search metrics, result captures, backlinks, keywords and sitemaps from landed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import blank, normalize_phrase, utrim
from ..functions.urls import has_user_info, host, host_matches, is_http
from ..plans.durable import Scratch

_ROWS = "rows ARRAY<STRUCT<keys ARRAY<STRING>, clicks DOUBLE, impressions DOUBLE, ctr DOUBLE, position DOUBLE>>"


def search_rows(raw: DataFrame) -> DataFrame:
    """Rows of API answers (column ``json``, keys query, page, date); a missing number fails the batch."""
    rows = raw.select(F.explode(F.from_json("json", _ROWS)["rows"]).alias("r")).select(
        utrim(F.col("r.keys")[0]).alias("query"), F.col("r.keys")[1].alias("page_url"), F.try_to_date(F.col("r.keys")[2], "yyyy-MM-dd").alias("date"), "r.clicks", "r.impressions", "r.ctr", "r.position"
    )
    missing = F.col("clicks").isNull() | F.col("impressions").isNull() | F.col("ctr").isNull() | F.col("position").isNull()
    checked = rows.filter(~blank(F.col("query")) & F.col("date").isNotNull()).withColumn("clicks", F.when(missing, F.raise_error(F.lit("a search metric lacks a measurement"))).otherwise(F.col("clicks")))
    return checked.withColumns({"clicks": F.bround("clicks", 0).cast("int"), "impressions": F.bround("impressions", 0).cast("int")})


def ingest_search_metrics(raw: DataFrame, keywords: DataFrame, metrics: DataFrame, project: str, country: str = "ALL", device: str = "ALL") -> tuple[DataFrame, DataFrame]:
    """New keywords and new metrics of a batch; rows whose key is known add nothing."""
    scratch = Scratch(raw.sparkSession, "search")
    rows = scratch.save(search_rows(raw).withColumn("normalized_phrase", normalize_phrase(F.col("query"))), "rows")
    known = keywords.filter((F.col("project_id") == project) & (F.col("country") == "ALL")).select("normalized_phrase", F.col("id").alias("keyword_id"))
    phrases = rows.groupBy("normalized_phrase").agg(F.min("query").alias("phrase"))
    fresh = phrases.join(known, "normalized_phrase", "left_anti").select(
        F.sha2(F.concat_ws("|", F.lit(project), "normalized_phrase"), 256).alias("id"), F.lit(project).alias("project_id"), "phrase", "normalized_phrase", F.lit("fa").alias("language"), F.lit("ALL").alias("country"), F.lit(False).alias("is_tracked")
    )
    every = known.unionByName(fresh.select("normalized_phrase", F.col("id").alias("keyword_id")))
    key = ["keyword_id", "date", "page_url", "country", "device"]
    made = rows.join(every, "normalized_phrase").select("keyword_id", "date", "page_url", F.lit(country.upper()).alias("country"), F.lit(device.upper()).alias("device"), "clicks", "impressions", "ctr", "position")
    first = made.withColumn("_k", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("impressions"), F.desc("clicks")))).filter("_k = 1").drop("_k")
    return fresh, first.join(metrics.select(*key), key, "left_anti").withColumn("project_id", F.lit(project))


def ingest_serp(payload: DataFrame, own_host: str, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """Results kept of each capture (snapshot_id, position, url, title), and the captures' digests."""
    limit = max(1, min(500, limit))
    valid = payload.filter("position > 0").withColumn("rank", F.row_number().over(W.partitionBy("snapshot_id").orderBy("position", "url")))
    kept = valid.filter(F.col("rank") <= limit).withColumn("is_owned", host_matches(host(F.col("url")), F.lit(own_host)))
    total = valid.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("total"))
    line = F.concat_ws("|", F.lpad(F.col("rank").cast("string"), 6, "0"), F.col("position").cast("string"), "url", F.coalesce("title", F.lit("")))
    own = kept.groupBy("snapshot_id").agg(
        F.count(F.lit(1)).alias("result_count"), F.min(F.when(F.col("is_owned"), F.col("position"))).alias("own_position"),
        F.min_by("url", F.when(F.col("is_owned"), F.col("position"))).alias("own_url"), F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("payload_hash"),
    )
    return kept, own.join(total, "snapshot_id").withColumn("truncated", F.col("total") > limit)


def ingest_backlinks(payload: DataFrame, limit: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Observations kept of each snapshot in the provider's order (ordinal), and the snapshots' digests."""
    limit = max(1, min(50_000, limit))
    ranked = payload.withColumn("rank", F.row_number().over(W.partitionBy("snapshot_id").orderBy("ordinal")))
    kept = ranked.filter(F.col("rank") <= limit)
    total = payload.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("total"))
    line = F.concat_ws("|", F.lpad(F.col("rank").cast("string"), 6, "0"), "source_url", "target_url", F.coalesce("anchor", F.lit("")))
    digest = kept.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("observation_count"), F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("payload_hash"))
    return kept, digest.join(total, "snapshot_id").withColumn("truncated", F.col("total") > limit)


def ingest_keywords(phrases: DataFrame, existing: DataFrame, quota_left: int, batch: int = 100) -> tuple[DataFrame, DataFrame]:
    """Keywords to add and how many of each project's list were skipped (project_id, ordinal, phrase)."""
    named = phrases.withColumn("phrase", utrim(F.col("phrase"))).filter(~blank(F.col("phrase"))).withColumn("normalized_phrase", normalize_phrase(F.col("phrase")))
    once = named.withColumn("_k", F.row_number().over(W.partitionBy("project_id", F.lower("phrase")).orderBy("ordinal"))).filter("_k = 1").drop("_k")
    first = once.withColumn("_n", F.row_number().over(W.partitionBy("project_id").orderBy("ordinal"))).filter(F.col("_n") <= batch).drop("_n")
    fresh = first.filter(F.length("phrase") <= 200).join(existing.select("project_id", "normalized_phrase"), ["project_id", "normalized_phrase"], "left_anti").dropDuplicates(["project_id", "normalized_phrase"])
    added = fresh.withColumn("_n", F.row_number().over(W.partitionBy("project_id").orderBy("ordinal"))).filter(F.col("_n") <= quota_left).drop("_n")
    counts = first.groupBy("project_id").agg(F.count(F.lit(1)).alias("asked")).join(added.groupBy("project_id").agg(F.count(F.lit(1)).alias("added")), "project_id", "left").fillna(0, ["added"])
    return added, counts.withColumn("skipped", F.col("asked") - F.col("added"))


_ENTRY = "loc STRING, lastmod STRING, changefreq STRING, priority STRING"


def _sitemap_rows(spark: SparkSession, paths: list[str], tag: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", "true").schema(_ENTRY).load(paths)


def sitemap_children(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Locations that sitemap index files list."""
    return _sitemap_rows(spark, paths, "sitemap").filter("loc is not null").select(utrim(F.col("loc")).alias("location")).distinct()


def sitemap_documents(landed: DataFrame, seeds: list[str], max_docs: int = 20) -> list[str]:
    """Paths of the sitemap files that a crawl reads: the seeds, then level by level the children that index files list.

    ``landed`` (location, path) tells where the file of a location lies.  The cap
    counts files found, in the order of level and location.
    """
    spark, taken, level = landed.sparkSession, [], sorted(set(seeds))
    done: set[str] = set()
    while level and len(taken) < max_docs:
        done |= set(level)
        rows = landed.filter(F.col("location").isin(level)).orderBy("location").limit(max_docs - len(taken)).collect()
        paths = [r["path"] for r in rows]
        taken += paths
        if not paths:
            break
        level = sorted({r["location"] for r in sitemap_children(spark, paths).orderBy("location").limit(max_docs + len(done)).collect()} - done)
    return taken


# States of a result or backlink feed.
FEED_STATES = ["NotConfigured", "Unavailable", "Partial", "Available"]


def feed_state(configured: Column, answered: Column, complete: Column) -> Column:
    """State of a feed's capture: no provider, no answer, part of the answer, all of it."""
    state = F.when(~F.coalesce(configured, F.lit(False)), FEED_STATES[0]).when(~F.coalesce(answered, F.lit(False)), FEED_STATES[1])
    return state.when(~F.coalesce(complete, F.lit(False)), FEED_STATES[2]).otherwise(FEED_STATES[3])


def sitemap_urls(spark: SparkSession, paths: list[str], max_docs: int = 20, max_urls: int = 50_000) -> DataFrame:
    """Entries of sitemap files (see ``sitemap_documents``): location, lastmod, changefreq, priority; a bad date or priority is null."""
    rows = _sitemap_rows(spark, paths[:max_docs], "url").withColumn("location", utrim(F.col("loc")))
    valid = rows.filter(is_http(F.col("location")) & ~has_user_info(F.col("location")) & (F.length("location") <= 2048))
    priority = F.col("priority").try_cast("decimal(3,1)")
    entries = valid.groupBy("location").agg(
        F.max(F.try_to_timestamp("lastmod")).alias("lastmod"), F.min(F.lower("changefreq")).alias("changefreq"), F.max(F.when(priority.between(0, 1), priority)).alias("priority")
    )
    return entries.orderBy("location").limit(max_urls)
