"""Search-result and backlink snapshots: latest, listing, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.urls import host, host_matches, serp_url_key

#: Availability states in which a snapshot has data.
WITH_DATA = ["Available", "Partial"]


def newest(snapshots: DataFrame, by: list[str], at: str, limit: int = 1) -> DataFrame:
    """The newest ``limit`` snapshots (1 to 60) of each key."""
    order = W.partitionBy(*by).orderBy(F.desc(at), F.desc("snapshot_id"))
    return snapshots.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(1, min(60, limit)))


def serp_results(snapshots: DataFrame, results: DataFrame, take: int = 200) -> DataFrame:
    """Results by position of snapshots with data, with a flag where more exist or the capture itself was cut (``truncated``)."""
    cut = F.col("truncated") if "truncated" in snapshots.columns else F.lit(False)
    known = results.join(snapshots.filter(F.col("availability").isin(WITH_DATA)).select("snapshot_id", F.coalesce(cut, F.lit(False)).alias("_cut")), "snapshot_id")
    order = W.partitionBy("snapshot_id").orderBy("position", "url")
    ranked = known.withColumn("rank", F.row_number().over(order)).withColumn("truncated", F.col("_cut") | (F.count(F.lit(1)).over(W.partitionBy("snapshot_id")) > take)).drop("_cut")
    return ranked.filter(F.col("rank") <= max(1, min(200, take)))


def own_position(results: DataFrame, own_host: Column) -> DataFrame:
    """Lowest position whose host is ours; null where we don't appear."""
    ours = F.when(host_matches(host(F.col("url")), own_host), F.col("position"))
    return results.groupBy("snapshot_id").agg(F.min(ours).alias("own_position"))


def serp_compare(old: DataFrame, new: DataFrame, by: str) -> DataFrame:
    """Movements between two captures (``by``, url, position) of each key: both, entered, dropped."""
    def keyed(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(by, serp_url_key(F.col("url")).alias("key")).agg(F.max("position").alias(name))

    both = keyed(old, "old_position").join(keyed(new, "new_position"), [by, "key"], "full_outer")
    delta = F.col("old_position") - F.col("new_position")
    kind = (
        F.when(F.col("old_position").isNull(), "entered").when(F.col("new_position").isNull(), "dropped")
        .when(delta > 0, "improved").when(delta < 0, "declined").otherwise("unchanged")
    )
    return both.select(by, "key", "old_position", "new_position", delta.alias("delta"), kind.alias("kind"))


def feature_changes(old: Column, new: Column) -> tuple[Column, Column]:
    """Feature kinds added and removed between two arrays of kinds."""
    return F.array_sort(F.array_except(new, old)), F.array_sort(F.array_except(old, new))


def _with_data(snapshots: DataFrame, pairs: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs (from_id, to_id) of snapshots that both have data, with both sides' columns; other pairs are refused."""
    known = snapshots.filter(F.col("availability").isin(WITH_DATA)).select("snapshot_id", *columns)
    old = known.select(F.col("snapshot_id").alias("from_id"), *[F.col(c).alias(f"old_{c}") for c in columns])
    new = known.select(F.col("snapshot_id").alias("to_id"), *[F.col(c).alias(f"new_{c}") for c in columns])
    return pairs.select("from_id", "to_id").join(old, "from_id").join(new, "to_id")


def movement(delta: Column) -> Column:
    return F.when(delta.isNull(), "unknown").when(delta > 0, "improved").when(delta < 0, "declined").otherwise("unchanged")


def serp_changes(snapshots: DataFrame, results: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Comparison of pairs of captures: a row for each pair, and its movements with the largest first.

    ``snapshots`` has snapshot_id, availability, own_position and features (an
    array of kinds).  A pair of which one side has no data is refused: it has
    no row, since everything would seem to have dropped out.
    """
    known = _with_data(snapshots, pairs, ["own_position", "features"])
    delta = F.col("old_own_position") - F.col("new_own_position")
    added, removed = feature_changes(F.col("old_features"), F.col("new_features"))
    totals = known.select("from_id", "to_id", F.col("old_own_position").alias("from_position"), F.col("new_own_position").alias("to_position"), delta.alias("position_delta"), movement(delta).alias("movement"), added.alias("features_added"), removed.alias("features_removed"))
    pair = F.struct("from_id", "to_id").alias("pair")
    side = lambda c: known.select(pair, F.col(c).alias("snapshot_id")).join(results, "snapshot_id").select("pair", "url", "position")
    moved = serp_compare(side("from_id"), side("to_id"), "pair")
    order = W.partitionBy("pair").orderBy(F.desc(F.abs(F.coalesce("delta", F.lit(0)))), F.coalesce("new_position", "old_position"), "key")
    return totals, moved.withColumn("rank", F.row_number().over(order)).select("pair.from_id", "pair.to_id", "key", "old_position", "new_position", "delta", "kind", "rank")


def backlink_changes(snapshots: DataFrame, observations: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Comparison of pairs of backlink snapshots: links gained and lost, and differences of totals where both measured them.

    ``snapshots`` has snapshot_id, availability, referring_domains and
    total_backlinks.  A pair of which one side has no data is refused.
    """
    known = _with_data(snapshots, pairs, ["referring_domains", "total_backlinks"])
    totals = known.select("from_id", "to_id", *[(F.col(f"new_{c}") - F.col(f"old_{c}")).alias(f"{c}_delta") for c in ("referring_domains", "total_backlinks")])
    side = lambda c: known.select("from_id", "to_id", F.col(c).alias("snapshot_id")).join(observations, "snapshot_id").select("from_id", "to_id", _link_key().alias("key")).distinct()
    old, new, key = side("from_id"), side("to_id"), ["from_id", "to_id", "key"]
    gained = new.join(old, key, "left_anti").withColumn("change", F.lit("added"))
    return totals, gained.unionByName(old.join(new, key, "left_anti").withColumn("change", F.lit("removed")))


def serp_pending(snapshots: DataFrame) -> DataFrame:
    """Captures without a result yet, the newest for each keyword, device and surface."""
    order = W.partitionBy("keyword_id", "device", "surface").orderBy(F.desc("created_at"), F.desc("snapshot_id"))
    return snapshots.filter("captured_at is null").withColumn("rank", F.row_number().over(order)).filter("rank = 1")


def backlink_observations(snapshots: DataFrame, observations: DataFrame, take: int = 500) -> DataFrame:
    """Observations of snapshots with data, new ones first, then by the source's host."""
    known = observations.join(snapshots.filter(F.col("availability").isin(WITH_DATA)).select("snapshot_id"), "snapshot_id", "left_semi")
    order = W.partitionBy("snapshot_id").orderBy(F.desc("is_new"), host(F.col("source_url")), "source_url", "target_url")
    ranked = known.withColumn("rank", F.row_number().over(order)).withColumn("truncated", F.count(F.lit(1)).over(W.partitionBy("snapshot_id")) > take)
    return ranked.filter(F.col("rank") <= max(1, min(500, take)))


def _link_key() -> Column:
    return F.concat(F.lower(F.trim("source_url")), F.lit("|"), F.lower(F.trim("target_url")))


def backlink_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Links gained and lost between two snapshots' observations."""
    a, b = (d.select(_link_key().alias("key")).distinct() for d in (old, new))
    gained = b.join(a, "key", "left_anti").withColumn("change", F.lit("added"))
    return gained.unionByName(a.join(b, "key", "left_anti").withColumn("change", F.lit("removed")))


def measured_deltas(old: DataFrame, new: DataFrame, columns: list[str], by: str) -> DataFrame:
    """Differences of snapshot totals; null unless both sides were measured, no row unless both have data."""
    a = old.filter(F.col("availability").isin(WITH_DATA)).select(by, *[F.col(c).alias(f"{c}_old") for c in columns])
    b = new.filter(F.col("availability").isin(WITH_DATA)).select(by, *columns)
    return a.join(b, by).select(by, *[(F.col(c) - F.col(f"{c}_old")).alias(f"{c}_delta") for c in columns])
