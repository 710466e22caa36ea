"""Audit of how text filters interact: what each one removes, alone and behind the others, in every order.

Four filters look at a text alone; the fifth, for copies, at the whole table.
It is decided by radix tries.  Each task first inserts its own texts into
compressed tries whose terminals hold the least id: only the row of the least
id goes on with its text, the other rows of the terminal are copies already.
What goes on is range-partitioned by text prefixes that grow where many texts
begin alike, so that equal texts meet and a family of near copies spreads over
partitions; tries over whole texts, again with the least id at each terminal,
are traversed there for the flags of the rest.

A document is then a mask of five bits.  Masks are counted by part and label
first; the 120 orders are evaluated on these counts, at most 128 a part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.durable import Scratch, small_batches
from .tries import Trie

FILTERS = "ABCDE"
COPY = FILTERS.index("E")
#: Bytes of text in a trie before it is traversed and dropped, where the order allows.
TRIE_BYTES = 24 << 20
#: Bytes of text a range partition should hold at most.
PART_BYTES = 24 << 20
#: Characters of the prefixes tried in turn; beyond the last one the digest of the whole text goes along.
DEPTHS = (16, 64, 256, 1024)
#: A prefix is split further if the texts below it fill more than one part in so many of a partition.
SPLIT = 4
#: Buckets that prefixes of a depth are counted in.
BUCKETS = 1 << 20
_UPPER = bytes(range(65, 91))
_CONTINUED = bytes(range(0x80, 0xC0))
_MARKS = b"#$%&*|"


def own_mask(text: bytes) -> int:
    """Bits of the filters A to D that the text fails; words are runs of bytes other than white space."""
    words = text.split()
    n, distinct = len(words), len(set(words))
    upper = len(text) - len(text.translate(None, _UPPER))
    points = len(text.translate(None, _CONTINUED))
    marked = len(text.translate(None, _MARKS)) < len(text)
    return (n < 200) | (100 * distinct < 50 * n) << 1 | (100 * upper > 2 * points) << 2 | marked << 3


def _texts(column: pa.Array) -> list[bytes]:
    return column.cast(pa.large_binary()).to_pylist()


def _first_tries(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows (id, part, body) of a task to rows (id, members, mask, body): without a body where the row is a copy for sure."""

    def traversed() -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], [], []]
        size = 0
        for least, rows in trie.terminals():
            text, mask = rows[0][1][1], rows[0][1][2]
            members: dict[tuple, dict[str, int]] = {}
            for key, (part, _, _) in rows:
                own = members.setdefault((key is None, key), {})
                own[part] = own.get(part, 0) + 1
            for (_, key), own in members.items():
                leads = key == least
                sent = text if leads else None
                size += len(sent or b"")
                for values, value in zip(out, (key, list(own.items()), mask if leads else mask | 1 << COPY, sent), strict=True):
                    values.append(value)
            if size > TRIE_BYTES // 8 or len(out[0]) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, schema, strict=True)], schema=schema)
                out, size = [[], [], [], []], 0
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, schema, strict=True)], schema=schema)

    trie, held = Trie(), 0
    for batch in batches:
        for key, part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _texts(batch.column(2)), strict=True):
            trie.insert(text, key, (part, text, own_mask(text)))
            held += 64
        if trie.bytes + held > TRIE_BYTES:
            yield from traversed()
            trie, held = Trie(), 0
    yield from traversed()


def _last_tries(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows (key, id, members, mask, body) in order of key to rows (id, members, mask) with the flag of copies."""

    def traversed() -> pa.RecordBatch:
        out: list[list] = [[], [], []]
        for least, rows in trie.terminals():
            for key, (members, mask) in rows:
                copy = least is not None and (key is None or key > least)
                for values, value in zip(out, (key, members, mask | copy << COPY), strict=True):
                    values.append(value)
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, schema, strict=True)], schema=schema)

    trie, before = Trie(), None
    for batch in batches:
        prefixes, texts = batch.column(0).to_pylist(), _texts(batch.column(4))
        for prefix, key, members, mask, text in zip(prefixes, batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), texts, strict=True):
            # Equal texts have equal prefixes, so none of the texts to come is in this trie.
            if trie.bytes > TRIE_BYTES and prefix != before:
                yield traversed()
                trie = Trie()
            trie.insert(text, key, (members, mask))
            before = prefix
    yield traversed()


def _prefixes(scratch: Scratch, sent: DataFrame) -> tuple[DataFrame, int]:
    """Adds ``key``, the shortest of the prefixes that few enough bytes of text lie below, and says how many ranges to make.

    The prefixes of a depth that are split are fewer than ``SPLIT`` times the ranges, which bounds what is broadcast.
    """
    spark = sent.sparkSession
    depths = [F.struct(F.lit(d).alias("depth"), F.pmod(F.xxhash64(F.substring("body", 1, d)), F.lit(BUCKETS)).cast("int").alias("bucket")) for d in DEPTHS]
    sizes = sent.select(F.octet_length("body").cast("bigint").alias("size"), F.explode(F.array(*depths)).alias("at"))
    sizes = scratch.save(sizes.groupBy("at.depth", "at.bucket").agg(F.sum("size").alias("size")), "prefixes")
    total = sizes.filter(F.col("depth") == DEPTHS[0]).agg(F.sum("size")).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PART_BYTES + 1)
    heavy = sizes.filter(F.col("size") > F.lit(max(1, total // (SPLIT * ranges))))
    key, keyed = F.concat(F.substring("body", 1, DEPTHS[-1]), F.sha2("body", 256)), sent
    for d in reversed(DEPTHS):
        own = heavy.filter(F.col("depth") == d).select(F.col("bucket").alias(f"bucket_{d}"), F.lit(True).alias(f"heavy_{d}"))
        keyed = keyed.withColumn(f"bucket_{d}", F.pmod(F.xxhash64(F.substring("body", 1, d)), F.lit(BUCKETS)).cast("int")).join(F.broadcast(own), f"bucket_{d}", "left")
        key = F.when(F.col(f"heavy_{d}").isNull(), F.substring("body", 1, d)).otherwise(key)
    return keyed.select(key.alias("key"), *sent.columns), ranges


def filter_masks(docs: DataFrame, part: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Which of the five filters documents fail: rows (id, part, mask, n), n documents each; bit 0 of the mask is filter A.

    A: under 200 words; B: fewer than half of the words are different; C: more
    than 2 % of the code points are A-Z; D: holds one of ``#$%&*|``; E: the same
    text as a document with a smaller id.

    * null text: empty, hence fails A; empty texts are copies of one another;
    * null part: the empty string; very long texts: judged and compared whole;
    * null id: larger than every id, so the row fails E if and only if a row
      with an id has its text; rows with one id and text don't make copies of
      each other;
    * empty table: empty result; other columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "filters")
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(part.cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    kind = dict(source.dtypes)["id"]
    members = "members array<struct<part:string,n:bigint>>"
    first = f"id {kind}, {members}, mask int, body string"
    last = f"id {kind}, {members}, mask int"

    def first_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _first_tries(batches, first_schema)

    def last_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _last_tries(batches, last_schema)

    last_schema = pa.schema([_arrow(spark, source, "id"), pa.field("members", _MEMBERS), pa.field("mask", pa.int32())])
    first_schema = last_schema.append(pa.field("body", pa.binary()))
    found = scratch.save(source.mapInArrow(first_tries, first.replace("body string", "body binary")).withColumn("body", F.col("body").cast("string")), "sent")
    sent, ranges = _prefixes(scratch, found.filter("body is not null"))
    ordered = sent.repartitionByRange(ranges, "key").sortWithinPartitions("key")
    judged = ordered.mapInArrow(last_tries, last).unionByName(found.filter("body is null").drop("body"))
    return judged.select("id", F.explode("members").alias("member"), "mask").select("id", "member.part", "mask", "member.n")


_MEMBERS = pa.list_(pa.struct([pa.field("part", pa.string()), pa.field("n", pa.int64())]))


def _arrow(spark, rows: DataFrame, column: str) -> pa.Field:
    """The Arrow type of a column."""
    return rows.limit(0).select(column).toArrow().schema.field(0)


def orders() -> list[tuple[str, int, int, int]]:
    """Every order of the filters, step by step: (order, step, bits of the filters before, bit of the filter)."""
    found = []
    for names in permutations(FILTERS):
        before = 0
        for step, name in enumerate(names, 1):
            bit = 1 << FILTERS.index(name)
            found.append(("".join(names), step, before, bit))
            before |= bit
    return found


def interactions(masks: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of each part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``masks`` is what ``filter_masks`` returns; ``labels`` has ``id_col``,
    quality and toxic (a document with several rows is good, or toxic, if one of
    them says so; without rows it is neither).  ``shapley`` sums what a step's
    filter removes over all orders: a document that fails k filters is removed
    by each of them in one k-th of the orders.
    """
    flags = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    n = F.col("n")
    cells = (
        masks.join(flags, "id", "left")
        .groupBy("part", "mask")
        .agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good") == 1, n).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic") == 1, n).otherwise(0)).alias("bad"))
    )
    # Steps of different orders with the same filters before them count alike: 80 of 600 differ.
    every = masks.sparkSession.createDataFrame(orders(), "filter_order string, step int, before int, bit int")
    kinds = sorted({(before, bit) for _, _, before, bit in orders()})
    steps = F.explode(F.array(*[F.struct(F.lit(before).alias("before"), F.lit(bit).alias("bit")) for before, bit in kinds])).alias("at")
    mask, before, bit = F.col("mask"), F.col("before"), F.col("bit")
    fails, late = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(before) != 0
    count = lambda cond, c=n: F.sum(F.when(cond, c).otherwise(0))
    summed = (
        cells.select("*", steps)
        .select("*", "at.before", "at.bit")
        .groupBy("part", "before", "bit")
        .agg(
            count(mask.bitwiseAND(before.bitwiseOR(bit)) == 0).alias("kept"),
            count(fails & ~late).alias("removed"),
            count(fails & late).alias("redundant"),
            count(mask == bit).alias("unique_fails"),
            count(fails & ~late, F.col("good")).alias("good_lost"),
            count(fails & ~late, F.col("bad")).alias("toxic_lost"),
            count(fails, n * F.lit(factorial(len(FILTERS))) / F.bit_count(mask)).cast("bigint").alias("shapley"),
        )
    )
    return summed.join(F.broadcast(every), ["before", "bit"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
