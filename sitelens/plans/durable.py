"""Intermediate tables that survive lost executors.

Lineage is cut by writing Parquet below the shared folder named in
``spark.checkpoint.dir``; every executor and the driver can read it back.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only where none is set and everything runs in one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sitelens-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/sitelens/{label}-{uuid.uuid4().hex[:12]}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing will read again."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def partitions(spark: SparkSession, pattern: str) -> list[str]:
    """Folders that a pattern of a table's path matches."""
    target = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    return [str(f.getPath().toString()) for f in found] if found is not None else []


def small_batches(spark: SparkSession, rows: int = 500, size: int = 16 << 20) -> None:
    """Rows and bytes an Arrow batch holds at most, so that whole texts of any length fit a Python worker's memory.

    A session with lower bounds of its own keeps them.  The bounds stay in the
    session, as results are computed after the call that plans them.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    held = re.fullmatch(r"(-?\d+)b?", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"))
    if held and not 0 < int(held[1]) <= size:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


class Scratch:
    """Written intermediate tables of one job; ``drop`` frees those no longer read."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label, self.paths = spark, label, {}

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(self.spark, f"{self.label}-{name}")
        df.write.option("compression", "zstd").parquet(path)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            for path in self.paths.pop(name, []):
                remove(self.spark, path)
