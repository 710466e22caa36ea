"""Near-duplicate embeddings: iterative quantisation, multi-index Hamming tables, rerank.

Rotations that balance sign bits are learnt on a bounded sample.  Each vector's
code is cut into keys, one for each Hamming table; keys are as long as the
largest label needs to keep buckets small, and there are as many tables as it
then takes to find nearly every pair at the threshold.

1. Vectors of one label that agree in a key meet in a bucket by their codes
   alone; those with a code nearby in it go on.
2. They meet again with their original vectors, in blocks.  A pair is counted
   in the first table in which it meets, so counts add up without listing pairs,
   and a block hands on one spanning forest of its links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import connected_components
from ..operators.groups import groups
from ..plans.durable import Scratch

#: Vectors the rotations are learnt on, at most.
SAMPLE = 20_000
STEPS = 30
#: Bits of a key, and how many vectors of a label a bucket may hold on average before keys get longer.
KEY_BITS, MOST_KEY_BITS, FILL = 16, 32, 256
#: Share of pairs just at the threshold that may meet in no table.
MISSED = 0.005
BLOCK_KEYS = ["t", "bucket", "p", "q"]
#: A bucket beyond this many vectors is compared block by block.
BLOCK = 1_000


def tables_for(largest: int, threshold: float) -> tuple[int, int]:
    """Bits of a key and number of tables for the largest label."""
    bits = min(MOST_KEY_BITS, max(KEY_BITS, math.ceil(math.log2(max(1, largest / FILL)))))
    same = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(MISSED) / math.log(1 - same)))


def learn(sample: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and stacked rotations (dims x bits) from sample rows; without rows the rotations are random ones."""
    dims = sample.shape[1]
    mean = sample.mean(axis=0) if len(sample) else np.zeros(dims)
    centred = sample - mean
    _, axes = np.linalg.eigh(centred.T @ centred + 1e-9 * np.eye(dims))
    projected = centred @ axes
    rng = np.random.default_rng(41)
    found = []
    for _ in range(-(-bits // dims)):
        r, _ = np.linalg.qr(rng.standard_normal((dims, dims)))
        for _ in range(STEPS if len(sample) else 0):
            u, _, v = np.linalg.svd(np.sign(projected @ r).T @ projected)
            r = (u @ v).T
        found.append(axes @ r)
    return mean, np.hstack(found)[:, :bits]


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; the largest component is taken out first, so that no square leaves the doubles."""
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def code_keys(vectors: np.ndarray, mean: np.ndarray, rotations: np.ndarray, key_bits: int) -> np.ndarray:
    """Keys of each row, a column for each table."""
    bits = ((vectors - mean) @ rotations > 0).astype(np.int64)
    return bits.reshape(len(vectors), -1, key_bits) @ (1 << np.arange(key_bits))


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links (a, b) among n nodes."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept


def _compared(batches: Iterator[pa.RecordBatch], kind: str, threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block; of each: links of a vector in it, and a forest's edges."""

    def block(rows: pa.Table, table: int, same: bool) -> Iterator[tuple]:
        ids = rows["id"].to_numpy()
        weight = rows["copies"].to_numpy()
        side = rows["side"].to_numpy()
        keys = np.frombuffer(b"".join(rows["keys"].to_pylist()), dtype="<u4").reshape(len(ids), -1)
        v = unit(np.frombuffer(b"".join(rows["vector"].to_pylist()), dtype=kind).reshape(len(ids), -1).astype(np.float64))
        left = np.flatnonzero(side == 0)
        right = left if same else np.flatnonzero(side == 1)
        for at in range(0, len(left), BLOCK):
            part = left[at : at + BLOCK]
            a, b = np.nonzero(v[part] @ v[right].T >= threshold)
            a, b = part[a], right[b]
            if same:
                a, b = a[a < b], b[a < b]
            fresh = ~(keys[a, :table] == keys[b, :table]).any(axis=1)
            a, b = a[fresh], b[fresh]
            if not len(a):
                continue
            n = np.bincount(a, weight[b], len(ids)) + np.bincount(b, weight[a], len(ids))
            for i in np.flatnonzero(n):
                yield int(ids[i]), int(n[i]), None
            for x, y in _forest(len(ids), a, b):
                yield int(ids[x]), 0, int(ids[y])

    for rows in groups(batches, BLOCK_KEYS):
        if len(rows) > 1:
            t, p, q = (rows[c][0].as_py() for c in ("t", "p", "q"))
            found = list(block(rows, t, p == q))
            if found:
                ids, n, other = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(other, pa.int64())], ["id", "n", "other"])


def _nearby(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Of each block, the members with another one whose code differs in ``most`` bits at most."""
    for rows in groups(batches, BLOCK_KEYS):
        if len(rows) < 2:
            continue
        side = rows["side"].to_numpy()
        codes = np.frombuffer(b"".join(rows["keys"].to_pylist()), dtype="<u4").reshape(len(side), -1)
        same = rows["p"][0].as_py() == rows["q"][0].as_py()
        left = np.flatnonzero(side == 0)
        right = left if same else np.flatnonzero(side == 1)
        near = np.zeros(len(side), dtype=bool)
        for at in range(0, len(left), 64):
            part = left[at : at + 64]
            differ = np.zeros((len(part), len(right)), dtype=np.int64)
            for column in codes.T:
                differ += np.bitwise_count(column[part, None] ^ column[None, right])
            close = differ <= most
            if same:
                close[np.arange(len(part)), np.arange(at, at + len(part))] = False
            near[part] |= close.any(axis=1)
            near[right] |= close.any(axis=0)
        some = np.flatnonzero(near)
        if len(some):
            yield rows.select(["t", "bucket", "id"]).take(pa.array(some)).combine_chunks().to_batches()[0]


def _in_blocks(entries: DataFrame, columns: list[str]) -> DataFrame:
    """Entries (t, bucket, id and the given columns) dealt to the pairs of blocks of their buckets, sorted by block."""
    sizes = entries.groupBy("t", "bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select("t", "bucket", F.ceil(F.col("members") / BLOCK).cast("int").alias("parts"))
    placed = entries.join(sizes, ["t", "bucket"]).withColumn("i", F.pmod(F.xxhash64("id", F.lit(7)), F.col("parts")).cast("int"))
    # A member of part i goes to the blocks (min(i, j), max(i, j)) for every part j.
    placed = placed.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks = placed.select("t", "bucket", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"), F.when(F.col("i") <= F.col("j"), 0).otherwise(1).alias("side"), "id", *columns)
    return blocks.repartition(*BLOCK_KEYS).sortWithinPartitions(*BLOCK_KEYS)


def near_duplicate_vectors(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98
) -> DataFrame:
    """Links between vectors of one label whose cosine is at least ``threshold``.

    Returns a row per vector: ``id_col``, n_links (other vectors linked
    directly), component_id (smallest id reachable, itself included), kept
    (id = component_id).

    * null label, null, empty or zero vector, null or non-finite components:
      linked with nothing; vectors of different lengths: not linked;
    * components of any finite size: compared after scaling;
    * ids are whole numbers, one vector each; a null id: a row with n_links 0
      and a null component_id that is not kept;
    * repeated vectors under different ids link with each other; repeated rows
      are one vector, and each row is returned; ties need no rule, since every
      pair is judged by itself;
    * empty table: empty result; other columns, whatever their names, are ignored.
    """
    spark = table.sparkSession
    scratch = Scratch(spark, "embeddings")
    element = table.schema[vector_col].dataType.elementType
    kind, cast = ("<f4", "float") if isinstance(element, T.FloatType) else ("<f8", "double")
    rows = table.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast(f"array<{cast}>").alias("v"))
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    valid = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    classes = scratch.save(valid.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("copies")), "classes")
    n = classes.count()
    dims = classes.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dims = dims["d"] if dims else 1
    largest = classes.groupBy("label").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("n")).first()["n"]
    key_bits, n_tables = tables_for(largest, threshold)
    bits = key_bits * n_tables
    sample = classes.filter((F.size("v") == dims) & (F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) < max(1, min(1 << 20, (SAMPLE << 20) // max(n, 1))))).select("v").limit(SAMPLE)
    fitted = np.array([r["v"] for r in sample.collect()], dtype=np.float64).reshape(-1, dims)
    model = spark.sparkContext.broadcast(learn(unit(fitted) if len(fitted) else fitted, bits))  # dims x bits numbers

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = {dims: model.value}
        for batch in batches:
            vectors = [np.asarray(x, dtype=kind) for x in batch.column(1).to_pylist()]
            sizes = np.array([len(x) for x in vectors])
            keys = np.zeros((len(vectors), n_tables), dtype=np.int64)
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                if size not in models:  # vectors of another length meet each other by random rotations
                    models[size] = learn(np.zeros((0, size)), bits)
                keys[rows] = code_keys(unit(np.stack([vectors[i] for i in rows]).astype(np.float64)), *models[size], key_bits)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x.tobytes() for x in vectors], pa.binary()), pa.array([k.astype("<u4").tobytes() for k in keys], pa.binary()), pa.array(keys.tolist(), pa.list_(pa.int64())), batch.column(2), batch.column(3)],
                ["id", "vector", "keys", "codes", "copies", "label"],
            )

    label_type = classes.schema["label"].dataType.simpleString()
    codes = classes.select("rep", "v", "copies", "label").mapInArrow(coded, f"id bigint, vector binary, keys binary, codes array<bigint>, copies bigint, label {label_type}")
    codes = scratch.save(codes, "codes")
    entries = codes.select("id", "keys", F.octet_length("vector").alias("size"), "label", F.posexplode("codes").alias("t", "code"))
    entries = entries.select("t", F.xxhash64("label", "size", "code").alias("bucket"), "id", "keys")
    # Codes of a pair at the threshold differ in so many bits, and six standard deviations more, at most.
    share = math.acos(min(1.0, threshold)) / math.pi
    most = math.ceil(bits * share + 6 * math.sqrt(bits * share * (1 - share)))
    near = _in_blocks(entries, ["keys"]).mapInArrow(lambda b: _nearby(b, most), "t int, bucket bigint, id bigint")
    near = scratch.save(near.distinct(), "near")
    whole = near.join(codes.select("id", "copies", "keys", "vector"), "id")
    found = scratch.save(_in_blocks(whole, ["copies", "keys", "vector"]).mapInArrow(lambda b: _compared(b, kind, threshold), "id bigint, n bigint, other bigint"), "found")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    components = connected_components(found.filter("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    per_class = (
        classes.join(counts.withColumnRenamed("id", "rep"), "rep", "left")
        .join(components.withColumnRenamed("node", "rep"), "rep", "left")
        .select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    )
    every = rows.join(per_class, ["label", "v"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return every.select(
        F.col("id").alias(id_col),
        F.when(F.col("id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
