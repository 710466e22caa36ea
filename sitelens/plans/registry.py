"""Registered queries over the given tables, each with its expected result in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles and arrays joined by commas, so that results compare by value."""

    def own(c: str, t: str):
        if t.startswith("decimal"):
            return F.col(c).cast("double").alias(c)
        if t in ("tinyint", "smallint", "int"):
            return F.col(c).cast("bigint").alias(c)
        if t.startswith("array"):
            return F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
        return F.col(c)

    return df.select(*[own(c, t) for c, t in df.dtypes])
