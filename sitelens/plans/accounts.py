"""Usage, quotas, entitlements and alerts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.rules import severity_rank

# Plan limits (plan, projects, pages a month, keywords, competitors, members, days kept, AI credits a month).
PLANS = [
    ("free", 1, 100, 10, 1, 1, 7, 5),
    ("starter", 3, 1_000, 25, 3, 3, 30, 25),
    ("pro", 10, 10_000, 150, 10, 10, 90, 100),
    ("enterprise", 50, 100_000, 1_000, 50, 50, 365, 500),
]


def plans(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PLANS, "plan string, max_projects int, max_pages int, max_keywords int, max_competitors int, max_members int, retention_days int, max_ai_credits int")


def billing_owner(users: DataFrame, projects: DataFrame, members: DataFrame) -> DataFrame:
    """Who pays for a user: themself with an own project, else the owner of a project they belong to (lowest id), else themself."""
    own = projects.select(F.col("owner_id").alias("user_id"), F.lit(True).alias("owns")).distinct()
    host_ = members.join(projects, "project_id").groupBy("user_id").agg(F.min("owner_id").alias("host"))
    owner = F.when(F.col("owns"), F.col("user_id")).otherwise(F.coalesce("host", "user_id"))
    return users.select("user_id").join(own, "user_id", "left").join(host_, "user_id", "left").select("user_id", owner.alias("owner_id"))


def usage(projects: DataFrame, crawls: DataFrame, pages: DataFrame, keywords: DataFrame, competitors: DataFrame, members: DataFrame, now: Column) -> DataFrame:
    """Per owner: live projects, pages of crawls begun this month, keywords, competitors, distinct members."""
    live = projects.filter(F.col("status") != "Archived")
    month = F.date_trunc("month", now)
    by_crawl = pages.groupBy("crawl_id").agg(F.count(F.lit(1)).alias("n"))
    recent = crawls.filter((F.col("started_at") >= month) & (F.col("started_at") < F.add_months(month, 1)))
    used = by_crawl.join(recent, "crawl_id").join(live.select("project_id", "owner_id"), "project_id").groupBy("owner_id").agg(F.sum("n").alias("pages"))

    def counted(rows: DataFrame, name: str, what: Column) -> DataFrame:
        return rows.join(live.select("project_id", "owner_id"), "project_id").groupBy("owner_id").agg(what.alias(name))

    out = live.groupBy("owner_id").agg(F.count(F.lit(1)).alias("projects")).join(used, "owner_id", "left")
    out = out.join(counted(keywords, "keywords", F.count(F.lit(1))), "owner_id", "left").join(counted(competitors, "competitors", F.count(F.lit(1))), "owner_id", "left")
    return out.join(counted(members, "members", F.count_distinct("user_id")), "owner_id", "left").fillna(0)


def quota_check(used: DataFrame, limits: DataFrame, requested: int = 1) -> DataFrame:
    """Which limits an owner has reached."""
    return used.join(limits, "owner_id").select(
        "owner_id", (F.col("projects") >= F.col("max_projects")).alias("projects_full"), (F.col("pages") + max(1, requested) > F.col("max_pages")).alias("pages_full"),
        (F.col("keywords") >= F.col("max_keywords")).alias("keywords_full"), (F.col("competitors") >= F.col("max_competitors")).alias("competitors_full"),
    )


def entitlements(owners: DataFrame, subscriptions: DataFrame, now: Column) -> DataFrame:
    """Limits of each owner: those of an active plan, else the free one's."""
    active = F.col("status").isin("Active", "Trialing") & (F.col("period_end").isNull() | (F.col("period_end") > now))
    rows = owners.select("owner_id").distinct().join(subscriptions, "owner_id", "left").withColumn("is_active", F.coalesce(active, F.lit(False)))
    rows = rows.withColumn("plan", F.when(F.col("is_active"), F.col("plan")).otherwise("free"))
    return rows.select("owner_id", "is_active", "plan").join(F.broadcast(plans(owners.sparkSession)), "plan")


def alert_check(rules: DataFrame, scores: DataFrame, crawls: DataFrame, issues: DataFrame) -> DataFrame:
    """Rules (rule_id, project_id, type, threshold) that fire on each project's newest scores, crawl and open issues."""
    order = W.partitionBy("project_id").orderBy("created_at", "crawl_id")
    back = W.partitionBy("project_id").orderBy(F.desc("created_at"), F.desc("crawl_id"))
    newest = scores.withColumn("previous", F.lag("overall").over(order)).withColumn("k", F.row_number().over(back)).filter("k = 1").select("project_id", "overall", "previous")
    last = crawls.withColumn("k", F.row_number().over(back)).filter("k = 1").select("project_id", F.col("crawl_id").alias("last_crawl"), F.col("status").alias("crawl_status"))
    seen = issues.filter(F.col("status") == "Open").join(last, (issues.project_id == last.project_id) & (F.col("crawl_id") == F.col("last_crawl"))).groupBy(issues.project_id.alias("project_id")).agg(
        F.count_if(F.col("severity") == "Critical").alias("critical"),
        F.count_if(F.col("code").isin("DUPLICATE_TITLE_TAG", "KEYWORD_CANNIBALIZATION")).alias("clashes"),
        F.count_if(F.col("code").isin("THIN_CONTENT", "LOW_WORD_COUNT")).alias("thin"),
        F.count_if(F.col("code") == "ORPHAN_PAGE").alias("orphans"),
    )
    rows = rules.filter("is_enabled").join(newest, "project_id", "left").join(last, "project_id", "left").join(seen, "project_id", "left").fillna(0, ["critical", "clashes", "thin", "orphans"])
    kind, limit = F.col("type"), F.col("threshold")
    fires = (
        F.when(kind == "SCORE_DROP", F.col("overall") < F.col("previous") - limit).when(kind == "CRITICAL_ISSUE", F.col("critical") > 0)
        .when(kind == "CRAWL_FAILURE", F.col("crawl_status") == "Failed").when(kind == "CANNIBALIZATION_DETECTED", F.col("clashes") > 0)
        .when(kind == "THIN_CONTENT_SPIKE", F.col("last_crawl").isNotNull() & (F.col("thin") >= limit)).when(kind == "ORPHAN_PAGES_DETECTED", F.col("last_crawl").isNotNull() & (F.col("orphans") >= limit))
    )
    payload = F.to_json(F.struct(kind.alias("rule"), F.col("overall").alias("score"), F.col("previous").alias("previousScore"), F.col("last_crawl").alias("crawlId")), {"ignoreNullFields": "false"})
    return rows.filter(F.coalesce(fires, F.lit(False))).select("rule_id", "project_id", "type", payload.alias("payload"))


def _unbarred(candidates: DataFrame, events: DataFrame, width: int) -> DataFrame:
    """Candidates without an event of their rule in the ``width`` microseconds up to their time, by bins of that width.

    Such an event lies in a candidate's own bin or the one before.  In its own
    bin the first event decides, in the one before the last; so events are two
    numbers for each rule and bin, and a rule of any number of events spreads
    over its bins.
    """
    at = F.unix_micros(F.col("detected_at").cast("timestamp"))
    bins = events.select("rule_id", at.alias("at")).groupBy("rule_id", F.floor(F.col("at") / width).alias("_bin")).agg(F.min("at").alias("_first"), F.max("at").alias("_last"))
    asked = candidates.withColumn("_at", at).withColumn("_bin", F.floor(F.col("_at") / width))
    rows = asked.join(bins.drop("_last"), ["rule_id", "_bin"], "left").join(bins.select("rule_id", (F.col("_bin") + 1).alias("_bin"), "_last"), ["rule_id", "_bin"], "left")
    barred = F.coalesce(F.col("_first") <= F.col("_at"), F.lit(False)) | F.coalesce(F.col("_last") >= F.col("_at") - width, F.lit(False))
    return rows.filter(~barred).select(candidates.columns)


def alert_cooldown(candidates: DataFrame, events: DataFrame, hours: int = 24) -> DataFrame:
    """Candidates (rule_id, detected_at, event_id) that become events: none of their rule in the ``hours`` before.

    Stored events count, and so do the candidates that go through: each rule's
    are taken in order of time, and the next one is the first more than
    ``hours`` after the last.
    """
    free = _unbarred(candidates, events, hours * 3_600_000_000).select("rule_id", "event_id", "detected_at")
    ordered = free.repartition("rule_id").sortWithinPartitions("rule_id", "detected_at", "event_id")
    gap = pd.Timedelta(hours=hours)

    def taken(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A rule may go on in the next batch: its last event is all that is carried over.
        rule, last = None, None
        for batch in batches:
            keep = []
            for own, rows in batch.groupby("rule_id", sort=False):
                if own != rule:
                    rule, last = own, None
                times = rows["detected_at"]
                at = 0 if last is None else int(times.searchsorted(last + gap, side="right"))
                while at < len(rows):
                    keep.append(rows.index[at])
                    last = times.iloc[at]
                    at = int(times.searchsorted(last + gap, side="right"))
            yield batch.loc[keep]

    return ordered.mapInPandas(taken, ordered.schema)


def alert_events(events: DataFrame, rules: DataFrame, top: int = 100) -> tuple[DataFrame, DataFrame]:
    """The newest events of each project, and a delivery row with the event's payload for each event of a webhook or e-mail rule."""
    order = W.partitionBy("project_id").orderBy(F.desc("detected_at"), F.desc("event_id"))
    newest = events.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    sent = events.join(rules.filter(F.col("channel").isin("webhook", "email")).select("rule_id", "channel", "destination"), "rule_id")
    return newest, sent.select("event_id", "project_id", "channel", "destination", "payload", F.lit("Pending").alias("status"))


def worst_first(issues: DataFrame) -> list[Column]:
    """Order of issue lists: severity, then code."""
    return [F.desc(severity_rank(F.col("severity"))), F.col("code")]
