"""Documents under whole-number keys, whatever their identifiers are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.durable import Scratch


def unique(docs: DataFrame, id_col: str) -> bool:
    """Whether no id occurs twice and none is null."""
    row = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.when(F.col(id_col).isNull(), 2).otherwise(F.col("n"))).alias("most")).first()
    return (row["most"] or 0) <= 1


def by_id(docs: DataFrame, id_col: str) -> bool:
    """Whether ids can serve as keys: whole numbers, every one of a single row."""
    return isinstance(docs.schema[id_col].dataType, T.IntegralType) and unique(docs, id_col)


def keyed(scratch: Scratch, docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (id, doc, body) and the documents among them (doc, id, body), each once.

    ``doc`` is the id itself where ids are whole numbers and every one names one
    row.  Otherwise each different pair of id and text, nulls included, is a
    document and gets a number in the order of id and text; that takes a written
    copy of the texts.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    if by_id(docs, id_col):
        rows = rows.select("id", F.col("id").cast("bigint").alias("doc"), "body")
        return rows, rows.select("doc", "id", "body")
    texts = rows.dropDuplicates(["id", "body"]).orderBy("id", "body").select(F.monotonically_increasing_id().alias("doc"), "id", "body")
    texts = scratch.save(texts, "documents")
    named = texts.withColumnsRenamed({"id": "_id", "body": "_body"})
    return rows.join(named, rows["id"].eqNullSafe(named["_id"]) & rows["body"].eqNullSafe(named["_body"])).select("id", "doc", "body"), texts
