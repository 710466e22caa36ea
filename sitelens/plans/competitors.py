"""Competitor comparison, topic gaps and crawl digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import blank, clean_topic
from .durable import Scratch


def _metrics() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("pages"), F.avg("word_count").alias("mean_words"), F.avg("response_ms").alias("mean_ms"), F.avg(F.col("is_indexable").cast("int")).alias("indexable"),
        F.avg((~blank(F.col("title"))).cast("int")).alias("with_title"), F.avg(F.col("has_description").cast("int")).alias("with_description"), F.sum("internal_links").alias("internal_links"),
    ]


def site_metrics(pages: DataFrame, *by: str) -> DataFrame:
    """Page count, means and shares; null means where there are no pages."""
    return pages.groupBy(*by).agg(*_metrics())


def latest(crawls: DataFrame, by: str) -> DataFrame:
    """The newest crawl of each ``by``; the higher id among equals."""
    return crawls.withColumn("_k", F.row_number().over(W.partitionBy(by).orderBy(F.desc("created_at"), F.desc("crawl_id")))).filter("_k = 1").drop("_k")


def compare_competitors(competitors: DataFrame, crawls: DataFrame, pages: DataFrame) -> DataFrame:
    """Each active competitor's latest crawl; metrics only if it completed."""
    newest = latest(crawls, "competitor_id").select("competitor_id", "crawl_id", "status")
    by_crawl = site_metrics(pages, "crawl_id")
    done = newest.filter(F.col("status") == "Completed").join(by_crawl, "crawl_id", "left").drop("status")
    return competitors.filter("is_active").select("competitor_id", "name").join(newest.drop("crawl_id"), "competitor_id", "left").join(done.drop("crawl_id"), "competitor_id", "left")


def _grams(topics: DataFrame) -> DataFrame:
    """The trigrams of each topic (topic, g), each once."""
    at = F.sequence(F.lit(1), F.length("topic") - 2)
    return topics.select("topic", F.explode(F.array_distinct(F.transform(at, lambda i: F.substring("topic", i, F.lit(3))))).alias("g"))


def topic_matches(own: DataFrame, asked: DataFrame) -> DataFrame:
    """Pairs (topic, own) of distinct topics, three characters long or more, of which either holds the other.

    An index of q-grams in an order of rarity: all trigrams of the shorter text
    lie in the longer one, its rarest among them.  So one side is looked up by a
    single trigram, the one that the fewest topics have, and a beginning or
    ending that half of the topics share is never asked for unless a topic has
    nothing else.
    """
    scratch = Scratch(own.sparkSession, "topics")
    sides = {"own": scratch.save(own.select("topic").distinct(), "own"), "asked": scratch.save(asked.select("topic").distinct(), "asked")}
    grams = scratch.save(_grams(sides["own"].unionByName(sides["asked"]).distinct()), "grams")
    counts = grams.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    rarest = grams.join(counts, "g").groupBy("topic").agg(F.min(F.struct("n", "g")).alias("rarest")).select("topic", "rarest.g")
    rarest = scratch.save(rarest, "rarest")

    def pairs(inner: str, outer: str) -> DataFrame:
        short = sides[inner].join(rarest, "topic").select(F.col("topic").alias("short"), "g")
        long = grams.join(sides[outer], "topic", "left_semi").join(short.select("g").distinct(), "g", "left_semi").select(F.col("topic").alias("long"), "g")
        return short.join(long, "g").filter(F.col("long").contains(F.col("short"))).select(F.col("long" if outer == "asked" else "short").alias("topic"), F.col("short" if inner == "own" else "long").alias("own"))

    return pairs("own", "asked").unionByName(pairs("asked", "own")).distinct()


def topic_gaps(own_pages: DataFrame, pages: DataFrame, top: int = 25) -> DataFrame:
    """Competitor topics that the project lacks or covers with far fewer words, the first ``top`` per competitor.

    A topic matches when either text holds the other; among several the lowest one counts.
    """
    own = own_pages.filter(~blank(F.col("title"))).withColumn("topic", F.lower(clean_topic(F.col("title")))).filter(F.length("topic") >= 3)
    own = own.groupBy("topic").agg(F.max("word_count").alias("own_words"))
    rival = pages.filter(~blank(F.col("title"))).withColumn("topic", F.lower(clean_topic(F.col("title")))).filter(F.length("topic") >= 3)
    match = topic_matches(own, rival).groupBy("topic").agg(F.min("own").alias("own"))
    match = match.join(own.withColumnRenamed("topic", "own"), "own")
    rows = rival.join(match, "topic", "left")
    kind = F.when(F.col("own").isNull(), "MissingInProject").when((F.col("word_count") > F.col("own_words") * 1.5) & (F.col("word_count") >= 300), "CompetitorHasDeeperContent")
    rows = rows.withColumn("kind", kind)
    totals = rows.groupBy("competitor_id").agg(F.count_if(F.col("own").isNotNull()).alias("common"), F.count_if(F.col("own").isNull()).alias("missing"))
    order = W.partitionBy("competitor_id").orderBy("url")
    gaps = rows.filter("kind is not null").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return totals.join(gaps.select("competitor_id", "rank", "topic", "url", "word_count", "kind"), "competitor_id", "left")


def competitor_crawls(crawls: DataFrame, top: int = 20) -> DataFrame:
    """The newest crawls of each competitor."""
    order = W.partitionBy("competitor_id").orderBy(F.desc("created_at"), F.desc("crawl_id"))
    return crawls.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def competitor_snapshot(pages: DataFrame) -> DataFrame:
    """Digest of each competitor crawl."""
    return pages.groupBy("crawl_id").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(F.col("status") >= 400).alias("errors"), F.avg("word_count").alias("mean_words"), F.avg("response_ms").alias("mean_ms"),
        F.count_if("is_indexable").alias("indexable"), F.count_if(~blank(F.col("title"))).alias("with_title"), F.count_if("has_description").alias("with_description"),
    )
