"""The most frequent keys of a count table without sorting it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts that the keys of one level are divided into by their hash.
PARTS = 1 << 16


def most_frequent(counts: DataFrame, limit: int, totals: list[str], key: str = "key") -> DataFrame:
    """Rows among the ``limit`` highest counts of any of the columns ``totals``, about.

    Counts are levelled to sixteenths of a power of two; whole levels are taken
    from the top down while they fit, and of the first that doesn't an even part
    by the hash of the key.  Each column has the whole limit to itself.  Only
    the sizes of the levels, about a thousand numbers a column, come to the
    driver.  ``counts`` is read twice.
    """
    levels = [F.when(F.col(c) > 0, F.floor(F.log2(F.col(c)) * 16)) for c in totals]
    entries = counts.select(F.posexplode(F.array(*levels)).alias("column", "level")).filter("level is not null")
    sizes: dict[int, list[tuple[int, int]]] = {}
    for r in entries.groupBy("column", "level").agg(F.count(F.lit(1)).alias("keys")).collect():
        sizes.setdefault(r["column"], []).append((r["level"], r["keys"]))
    part = F.pmod(F.xxhash64(key), F.lit(PARTS))
    chosen: list[Column] = []
    for column, own in sizes.items():
        held, lowest, share = 0, None, 0
        for level, keys in sorted(own, reverse=True):
            if held + keys > limit:
                lowest, share = level, PARTS * (limit - held) // keys
                break
            held += keys
        if lowest is None:
            chosen.append(levels[column].isNotNull())
        else:
            chosen.append((levels[column] > lowest) | ((levels[column] == lowest) & (part < share)))
    return counts.filter(F.coalesce(reduce(lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)), chosen), F.lit(False))) if chosen else counts.limit(0)
