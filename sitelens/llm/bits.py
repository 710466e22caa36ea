"""Bit tables of 64-bit keys, bounded in size, that tasks use to leave out rows early.

A false hit costs work only; no key of the table is ever missed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a table: 16 for each key, up to 16 MB.
BITS_EACH, MOST_BITS = 16, 1 << 27
#: Tables that stand before a shuffle of wide rows have so many times the bits: of other rows one in 64 to 128 passes.
SPARSE = 4


def bit_table(keys: DataFrame, n: int) -> tuple[int, bytes]:
    """The table of n keys (column ``key``), gathered by blocks of 4 kB."""
    bits = 1 << 15
    while bits < min(n * BITS_EACH, MOST_BITS):
        bits *= 2
    at = F.col("key").bitwiseAND(F.lit(bits - 1))
    blocks = keys.select(F.shiftright(at, 15).alias("block"), (at % 32768).alias("at")).groupBy("block").agg(F.bitmap_construct_agg("at").alias("bits"))
    table = bytearray(bits // 8)
    for row in blocks.collect():
        table[row["block"] * 4096 : (row["block"] + 1) * 4096] = row["bits"]
    return bits, bytes(table)


def hits(table: tuple[int, bytes], keys: np.ndarray) -> np.ndarray:
    """Which of the keys may be in the table."""
    at = (keys.astype(np.uint64) & np.uint64(table[0] - 1)).astype(np.int64)
    return ((np.frombuffer(table[1], dtype=np.uint8)[at >> 3] >> (at & 7)) & 1).astype(bool)


def among(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows whose ``column`` is among the keys (same column), and few others, which are left for a join to leave out.

    Wide rows that a join would only drop stay where they lie: none but their
    keys go to Python, and only those that may be wanted go through a shuffle.
    """
    keys = keys.select(F.xxhash64(column).alias("key"))
    sent = rows.sparkSession.sparkContext.broadcast(bit_table(keys, SPARSE * keys.distinct().count()))

    @F.arrow_udf("boolean")
    def wanted(found: pa.Array) -> pa.Array:
        return pa.array(hits(sent.value, found.to_numpy(zero_copy_only=False)))

    return rows.filter(wanted(F.xxhash64(column)))
