"""Positions of rows in an order within groups of any size, without a group in one task.

Rows are range-partitioned by group and order, so a large group spreads over
neighbouring partitions.  A row's position is its place in its partition plus
the number of rows of its group in the partitions before; those numbers are a
table of partitions, not of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.durable import Scratch


def ranked(rows: DataFrame, by: str, order: list[Column | str], name: str = "rank", between: tuple[int, int] | None = None) -> DataFrame:
    """Adds the position of each row (from 1) within its ``by`` as ``name``; ``order`` must tell rows of a group apart.

    ``between`` keeps the positions from one number to another: of the
    partitions only those that hold such positions are read on.
    """
    scratch = Scratch(rows.sparkSession, "ranks")
    keys = [F.col(by).asc_nulls_first(), *[F.col(c) if isinstance(c, str) else c for c in order]]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id())
    placed = scratch.save(placed, "placed").withColumn("_part", F.shiftright("_place", 33))
    group = F.struct(F.col(by).alias("key"))
    sizes = placed.groupBy(group.alias("_group"), "_part").agg(F.count(F.lit(1)).alias("n"), F.min("_place").alias("first"))
    # A row for each partition that a group lies in.
    before = F.coalesce(F.sum("n").over(W.partitionBy("_group").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("before", before)
    if between:
        starts = starts.filter((F.col("before") < between[1]) & (F.col("before") + F.col("n") >= between[0]))
    starts = scratch.save(starts.select("_group", "_part", (F.col("before") - F.col("first") + 1).alias("_shift")), "starts")
    joined = placed.withColumn("_group", group).join(starts, ["_group", "_part"])
    out = joined.withColumn(name, (F.col("_place") + F.col("_shift")).cast("bigint")).drop("_group", "_part", "_place", "_shift")
    return out.filter(F.col(name).between(*between)) if between else out
