"""Visibility to AI crawlers: access, signals, scores, advisories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.evidence import ENTITY_TYPES, has_type, question_heading, structured_data
from ..functions.text import blank
from ..operators.robots import robots_allowed

# Crawler profiles (key, user agent token, purpose, weight).
PROFILES = [
    ("openai-searchbot", "OAI-SearchBot", "AiSearch", "1.00"),
    ("chatgpt-user", "ChatGPT-User", "AnswerEngine", "1.00"),
    ("perplexitybot", "PerplexityBot", "AnswerEngine", "1.00"),
    ("claude-user", "Claude-User", "AnswerEngine", "1.00"),
    ("claude-searchbot", "Claude-SearchBot", "AiSearch", "1.00"),
    ("gptbot", "GPTBot", "Training", "0.80"),
    ("claudebot", "ClaudeBot", "Training", "0.80"),
    ("google-extended", "Google-Extended", "Training", "0.70"),
    ("applebot-extended", "Applebot-Extended", "Training", "0.70"),
    ("bytespider", "Bytespider", "Training", "0.60"),
    ("cohere-ai", "cohere-ai", "AiSearch", "0.60"),
]


def profiles(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(*p, True) for p in PROFILES], "key string, user_agent string, purpose string, weight string, is_enabled boolean")
    return rows.withColumn("weight", F.col("weight").cast("decimal(5,4)"))


def ai_crawler_access(hosts: DataFrame, rules: DataFrame, crawlers: DataFrame) -> DataFrame:
    """Access of every enabled crawler to each host's root: Blocked, Allowed (named and let in) or Unspecified.

    Hosts may carry ``has_robots``, whether a robots file was read; without one
    nothing is known of the host's access (Unknown).
    """
    profile = F.struct("key", "user_agent", "purpose", "weight")
    every = crawlers.filter("is_enabled").agg(F.collect_list(profile).alias("profiles")).scalar()  # a short list of names
    known = F.col("has_robots") if "has_robots" in hosts.columns else F.lit(True)
    asked = hosts.groupBy("host").agg(F.bool_or(F.coalesce(known, F.lit(False))).alias("has_robots")).withColumn("p", F.explode(every)).select("host", "has_robots", "p.*").withColumn("url", F.concat(F.lit("https://"), F.col("host"), F.lit("/")))
    judged = robots_allowed(asked, rules)
    named = rules.select("host", "agent").distinct().filter("agent <> '*'")
    found = judged.select("host", "user_agent").join(named, "host").filter(F.lower("user_agent").contains(F.col("agent"))).select("host", "user_agent").distinct().withColumn("named", F.lit(True))
    access = F.when(~F.col("has_robots"), "Unknown").when(~F.col("allowed"), "Blocked").when(F.col("named"), "Allowed").otherwise("Unspecified")
    return judged.join(found, ["host", "user_agent"], "left").select("host", "key", "user_agent", "purpose", "weight", access.alias("access"))


def ai_crawlability(access: DataFrame, by: str = "host") -> DataFrame:
    """Weighted mean of 100 / 70 / 0 over crawlers of positive weight; null where access is unknown."""
    value = F.when(F.col("access") == "Allowed", 100).when(F.col("access") == "Unspecified", 70).when(F.col("access") == "Blocked", 0)
    scored = access.filter("weight > 0").groupBy(by)
    return scored.agg(F.bround((F.sum(F.col("weight") * value) / F.sum(F.when(value.isNotNull(), F.col("weight")))).cast("decimal(18,8)"), 1).cast("decimal(5,1)").alias("crawlability"))


def ai_page_signals(pages: DataFrame, by: str = "crawl_id", sample: int | None = None) -> DataFrame:
    """Counts of signals over pages with text; ``sample`` takes the first so many by url."""
    if sample is not None:
        pages = pages.orderBy("url").limit(sample)
    pages = pages.withColumn("_data", structured_data(F.col("json_ld")))
    types = F.col("_data.types")
    counted: dict[str, Column] = {
        "question": question_heading(F.col("headings")),
        "faq": has_type(types, ["FAQPage", "QAPage"]),
        "schema": F.size(types) > 0,
        "entity": has_type(types, ENTITY_TYPES),
        "author": F.col("_data.dated"),
        "canonical": ~blank(F.col("canonical")),
        "concise": F.col("word_count").between(150, 1200),
        "structure": F.size(F.filter("headings", lambda h: ~blank(h["text"]))) >= 3,
        "evaluable": F.col("headings").isNotNull() & F.col("json_ld").isNotNull() & F.col("_data.valid"),
    }
    return pages.filter(~blank(F.col("text"))).groupBy(by).agg(F.count(F.lit(1)).alias("pages"), *[F.count_if(c).alias(f"n_{k}") for k, c in counted.items()])


def ai_scores(signals: DataFrame, crawlability: DataFrame, by: str = "crawl_id") -> DataFrame:
    """Answer, citation and access readiness and the visibility they make with crawlability; null if any is unknown."""
    rate = lambda c: F.col(f"n_{c}").cast("decimal(18,8)") / F.col("pages")
    one = lambda c: F.bround(c.cast("decimal(18,8)"), 1).cast("decimal(5,1)")
    rows = signals.filter("pages > 0").withColumns(
        {
            "answer": one(rate("question") * 30 + rate("faq") * 20 + rate("concise") * 20 + rate("structure") * 30),
            "citation": one(rate("schema") * 30 + rate("entity") * 30 + rate("canonical") * 20 + rate("author") * 20),
            "accessibility": one(rate("concise") * 100),
        }
    )
    rows = crawlability.join(rows, by, "full_outer")
    weights = {"crawlability": "0.40", "answer": "0.25", "citation": "0.25", "accessibility": "0.10"}
    total = sum((F.col(c).cast("decimal(10,4)") * F.lit(w).cast("decimal(3,2)") for c, w in weights.items()), F.lit(0).cast("decimal(10,4)"))
    return rows.select(by, *weights, one(total).alias("visibility"))


def ai_advisories(access: DataFrame, signals: DataFrame) -> DataFrame:
    """Advisory findings of each crawl: crawlers blocked; no question heading or FAQ though all pages could be judged."""
    blocked = access.filter(F.col("access") == "Blocked").groupBy("crawl_id").agg(F.array_join(F.array_sort(F.collect_set("user_agent")), ", ").alias("detail"))
    bare = signals.filter("pages > 0 and n_evaluable = pages and n_question = 0 and n_faq = 0").select("crawl_id", F.col("pages").cast("string").alias("detail"))
    code = lambda d, c, k: d.select("crawl_id", F.lit(c).alias("code"), F.lit("Notice").alias("severity"), F.lit(k).alias("category"), "detail")
    return code(blocked, "AEO_CRAWLERS_BLOCKED", "Indexability").unionByName(code(bare, "AEO_ANSWER_STRUCTURE_MISSING", "Content"))


def sync_advisories(existing: DataFrame, findings: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Advisories after a run: new ones open, known ones with fresh detail and the user's status, open ones that are gone left out.

    ``evaluated`` lists (crawl_id, code) that could be judged; others keep what they had.
    """
    key = ["crawl_id", "code"]
    old = existing.select(*key, "status", F.col("detail").alias("old_detail"), F.lit(True).alias("was"))
    both = old.join(findings.select(*key, "detail", F.lit(True).alias("now")), key, "full_outer").join(evaluated.select(*key, F.lit(True).alias("judged")), key, "left")
    gone = F.col("now").isNull() & F.coalesce("judged", F.lit(False)) & (F.col("status") == "Open")
    return both.filter(~F.coalesce(gone, F.lit(False))).select(*key, F.coalesce("status", F.lit("Open")).alias("status"), F.coalesce("detail", "old_detail").alias("detail"))


def visibility_snapshot(access: DataFrame, signals: DataFrame, scores: DataFrame) -> DataFrame:
    """One row per crawl: scores, numbers of allowed, blocked and unspecified crawlers, pages."""
    counts = access.groupBy("crawl_id").agg(*[F.count_if(F.col("access") == a).alias(a.lower()) for a in ("Allowed", "Blocked", "Unspecified")])
    return scores.join(counts, "crawl_id", "left").join(signals.select("crawl_id", "pages"), "crawl_id", "left")
