"""Connected components of an edge table by alternating large and small stars.

Each round is two groupings with partial aggregation and two joins on the node;
a node with very many neighbours is aggregated before its shuffle, and its join
is one that adaptive execution can split.  Only a count and a checksum come to
the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    passed = edges.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return passed.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _print(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Smallest reachable node of every node that has an edge to another one.

    ``edges`` has columns a and b, undirected; repeated edges, self-loops and
    nulls are allowed (the last two connect nothing).  Returns (node,
    component), one row for each node with a proper edge.
    """
    scratch = Scratch(edges.sparkSession, label)
    proper = edges.filter(F.col("a") != F.col("b"))
    now = scratch.save(proper.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges-0")
    before, turn = _print(now), 0
    while before[0]:
        turn += 1
        now = scratch.save(_small_star(_large_star(now)), f"edges-{turn}")
        after = _print(now)
        scratch.drop(f"edges-{turn - 1}")
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
