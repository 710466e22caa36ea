"""Clusters of duplicate and near-duplicate texts by word triples, exact at any threshold.

A similarity join without listed pairs.  Texts are sets of hashed shingles in
an order of rarity, and two similar ones share a shingle of their prefixes, so
the texts of one prefix shingle form a bucket.  Every text is first compared
with one lead of its buckets; a family of near copies is one component after
that.  What still lies in one bucket but in several components: the few texts
beside the bucket's largest component are paired by their ids, and only pairs
that the shared shingles and the places of these leave room for go on.
Where there are more than a few, texts are compared in pairs of blocks, and a
pair of blocks hands on a spanning forest: links that join components, never
more than its texts.

Whole sets are read last.  A text's sketch holds the parities of its shingles
by about as many counters, a bit for each shingle's eight bytes; parities that
differ are elements that only one of two sets has, so two sets with too many of
these aren't similar.  Only texts with a partner that the sketches leave have
their sets made, of the words where they lie.

The lowest similarity of a cluster needs no comparison of all pairs either:
Jaccard distance is a metric, so texts near the cluster's first one can't be
far from one another.  The farthest texts give a bound, and only shells whose
distances together exceed it are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import jaccard, normalize_text
from ..plans.durable import Scratch, small_batches
from .components import connected_components
from .groups import groups

#: Distinct texts that are compared with one another at a time.
BLOCK = 500
#: Distinct texts whose sketches are compared with one another at a time.
SKETCHES = 4_000
#: Texts whose sets are wanted are broadcast up to this many (16 bytes each).
BROADCAST_ROWS = 500_000
#: Texts beside the largest component of a bucket that are paired by ids.
FEW = 64
#: Counters of shingles by their hashes, 8 MB; the order of rarity needs no more than an order.
BUCKETS = 1 << 20
#: Shells of equal width that the distances from a cluster's first text fall into.
SHELLS = 64
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


class Duplicates(NamedTuple):
    """``clusters``: cluster (lowest id), size, similarity, exact; ``members``: cluster, id."""

    clusters: DataFrame
    members: DataFrame


def _shingles(words: np.ndarray) -> np.ndarray:
    """Distinct hashes of word triples, from hashes of words; those of the words where there are fewer than three."""
    if len(words) < 3:
        return np.unique(words)
    w = words.view(np.uint64)
    mixed = w[:-2] * _FACTORS[0]
    for k in (1, 2):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _FACTORS[k] + w[k : len(w) - 2 + k]
    mixed ^= mixed >> np.uint64(32)
    return np.unique((mixed * _FACTORS[0]).view(np.int64))


def _lists(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    """Lists of numbers, without an object for each number."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _sets(column: pa.Array) -> list[np.ndarray]:
    return [_shingles(words) for words in _lists(column)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of a task have shingles of each counter."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        if batch.num_rows:
            total += np.bincount(np.concatenate(_sets(batch.column(0))) & (BUCKETS - 1), minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])


def _ragged(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.array([], dtype=np.int64), pa.int64()))


def _common(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of sets, their elements as small numbers, and where each set starts."""
    n = np.array([len(x) for x in sets])
    return n, np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(n) - n


def _ten_thousandths(common: np.ndarray, union: np.ndarray) -> np.ndarray:
    """Shares in ten-thousandths, half to even."""
    part, rest = np.divmod(common * 10_000, np.maximum(union, 1))
    return part + ((2 * rest > union) | ((2 * rest == union) & (part % 2 == 1)))


def _folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """Parities of rows by so many words of their counters: halves are added without carry."""
    while sketch.shape[-1] > size:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def _sketch(s: np.ndarray) -> bytes:
    """Parities of a set's elements by as many counters as it has elements, or up to twice as many; 64 at least."""
    size = 1 << max(6, (len(s) - 1).bit_length())
    return np.packbits(np.bincount(s & (size - 1), minlength=size) & 1, bitorder="little").tobytes()


def _apart(total: np.ndarray, low: float) -> np.ndarray:
    """How many elements only one of two similar sets has at most, from the sum of their sizes; parities that differ tell no more than there are."""
    return total * (1 - low) / (1 + low) + 1e-6


def _near(batches: Iterator[pa.RecordBatch], low: float, least: int, joins: bool) -> Iterator[pa.RecordBatch]:
    """Of each pair of blocks, by sketches: pairs (a, b) that would join components if they are similar, or else all texts (key, rep) that may have a similar one in another component."""
    for rows in groups(batches, ["key", "p", "q"]):
        parts, reps = rows["component"].to_pylist(), rows["rep"].to_pylist()
        numbers = {c: i for i, c in enumerate(dict.fromkeys(parts))}
        if len(numbers) < 2:
            continue
        joined = np.array([numbers[c] for c in parts])
        side, n = rows["side"].to_numpy(), rows["n"].to_numpy()
        sketches = [np.frombuffer(x, dtype=np.uint64) for x in rows["k"].to_pylist()]
        width = np.array([len(x) for x in sketches])
        classes = {w: np.flatnonzero(width == w) for w in set(width.tolist())}
        tables = {(w, m): _folded(np.stack([sketches[j] for j in at]), m) for w, at in classes.items() for m in (w, w // 2) if m}
        alone = rows["p"][0].as_py() == rows["q"][0].as_py()
        flagged, a, b = np.zeros(len(n), dtype=bool), [], []
        for i in np.flatnonzero(side == 0):
            wanted = (np.arange(len(n)) > i if alone else side == 1) & (joined != joined[i]) & (np.minimum(n, n[i]) * 10_001 >= np.maximum(n, n[i]) * least)
            for w, at in classes.items():
                picked = wanted[at]
                if not picked.any():
                    continue
                m = min(w, width[i])  # sizes of similar sets differ by less than a factor of two
                differ = np.bitwise_count(tables[w, m][picked] ^ _folded(sketches[i], m)).sum(axis=1)
                found = at[picked][differ <= _apart(n[at[picked]] + n[i], low)]
                if joins:
                    for j in found:
                        if joined[i] != joined[j]:
                            a.append(reps[i])
                            b.append(reps[j])
                            joined[joined == joined[j]] = joined[i]
                elif len(found):
                    flagged[found] = flagged[i] = True
        kind = rows.schema.field("rep").type
        if joins and a:
            yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], ["a", "b"])
        elif flagged.any():
            keys = rows["key"].combine_chunks().filter(pa.array(flagged))
            yield pa.RecordBatch.from_arrays([keys, pa.array([reps[i] for i in np.flatnonzero(flagged)], kind)], ["key", "rep"])


def _forest(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Of each pair of blocks, links of at least that similarity that join components not joined yet."""
    for rows in groups(batches, ["key", "p", "q"]):
        reps, parts = rows["rep"].to_pylist(), rows["component"].to_pylist()
        numbers = {c: i for i, c in enumerate(dict.fromkeys(parts))}
        joined = np.array([numbers[c] for c in parts])
        if len(numbers) < 2:
            continue
        side = rows["side"].to_numpy()
        n, codes, first = _common(_lists(rows["s"]))
        held = np.zeros(len(codes) + 1, dtype=np.int64)
        alone = rows["p"][0].as_py() == rows["q"][0].as_py()
        a, b = [], []
        for i in np.flatnonzero(side == 0):
            others = np.flatnonzero((np.arange(len(n)) > i if alone else side == 1) & (joined != joined[i]) & (np.minimum(n, n[i]) * 10_001 >= np.maximum(n, n[i]) * least))
            if not len(others):
                continue
            held[codes[first[i] : first[i] + n[i]]] = 1
            common = np.add.reduceat(held[codes], first)[others]
            held[codes[first[i] : first[i] + n[i]]] = 0
            for j in others[_ten_thousandths(common, n[others] + n[i] - common) >= least]:
                if joined[i] != joined[j]:
                    a.append(reps[i])
                    b.append(reps[j])
                    joined[joined == joined[j]] = joined[i]
        if a:
            kind = rows.schema.field("rep").type
            yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], ["a", "b"])


def _lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block, the lowest similarity of its pairs in ten-thousandths, half to even."""
    for rows in groups(batches, ["cluster", "p", "q"]):
        side = rows["side"].to_numpy()
        n, codes, first = _common(_lists(rows["s"]))
        held = np.zeros(len(codes) + 1, dtype=np.int64)
        alone = rows["p"][0].as_py() == rows["q"][0].as_py()
        low = None
        for i in np.flatnonzero(side == 0):
            others = np.arange(len(n)) > i if alone else side == 1
            if not others.any():
                continue
            own = codes[first[i] : first[i] + n[i]]
            held[own] = 1
            common = np.add.reduceat(held[codes], first)[others] * (n[others] > 0)
            held[own] = 0
            part = int(_ten_thousandths(common, n[others] + n[i] - common).min())
            low = part if low is None else min(low, part)
        if low is not None:
            yield pa.RecordBatch.from_arrays([rows["cluster"].combine_chunks().slice(0, 1), pa.array([low], pa.int64())], ["cluster", "lowest"])


def _paired(rows: DataFrame, by: str, block: Column, partners: Column) -> DataFrame:
    """Rows in every pair of blocks that their own is part of: columns by, p, q, side and those of ``rows``, sorted by pair."""
    placed = rows.withColumn("_i", block).withColumn("_j", F.explode(partners))
    placed = placed.withColumns({"p": F.least("_i", "_j"), "q": F.greatest("_i", "_j"), "side": F.when(F.col("_i") <= F.col("_j"), 0).otherwise(1)}).drop("_i", "_j")
    return placed.repartition(by, "p", "q").sortWithinPartitions(by, "p", "q")


def _rarity_ordered(scratch: Scratch, rows: DataFrame, threshold: float) -> DataFrame:
    """Distinct texts of ``rows`` (row, id, hash, w) with the prefix that a similar text shares a shingle of, and the places of its shingles: rep, row, hash, copies, n, k (sketch), prefix, places."""
    spark = rows.sparkSession
    counts = rows.select("w").mapInArrow(_counted, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(BUCKETS, dtype=np.int64)
    table[counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    shared = spark.sparkContext.broadcast(table)
    kind = rows.schema["id"].dataType.simpleString()
    low = threshold - 0.00005  # the similarity is rounded to four places before it is compared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = shared.value
        for batch in batches:
            sets, prefixes, places = _sets(batch.column(3)), [], []
            for s in sets:
                seen = rarity[s & (BUCKETS - 1)]
                order = np.lexsort((s, seen))[: len(s) - int(np.ceil(len(s) * low)) + 1]
                places.append(np.flatnonzero(seen[order] > 1))
                prefixes.append(s[order][places[-1]])
            columns = [*batch.columns[:3], pa.array([len(s) for s in sets], pa.int64()), pa.array([_sketch(s) for s in sets], pa.binary()), _ragged(prefixes), _ragged(places)]
            yield pa.RecordBatch.from_arrays(columns, ["row", "id", "hash", "n", "k", "prefix", "places"])

    found = rows.select("row", "id", "hash", "w").mapInArrow(run, f"row bigint, id {kind}, hash string, n bigint, k binary, prefix array<bigint>, places array<bigint>")
    return scratch.save(found.groupBy("hash").agg(F.min("id").alias("rep"), F.min("row").alias("row"), F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("n", "k", "prefix", "places")]), "texts")


def _sets_of(scratch: Scratch, rows: DataFrame, texts: DataFrame, reps: DataFrame) -> DataFrame:
    """Whole sets (rep, s) of some of the texts, made of their words once more; the words of the others stay where they are."""
    wanted = scratch.save(texts.select("rep", "row").join(reps.select("rep").distinct(), "rep", "left_semi"), "wanted")
    words = rows.select("row", "w").join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted.hint("shuffle_merge"), "row").select("rep", "w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _ragged(_sets(batch.column(1)))], ["rep", "s"])

    kind = rows.schema["id"].dataType.simpleString()
    return scratch.save(words.mapInArrow(run, f"rep {kind}, s array<bigint>"), "sets")


def _confirmed(scratch: Scratch, rows: DataFrame, texts: DataFrame, pairs: DataFrame, threshold: float, name: str = "more") -> DataFrame:
    """Pairs (a, b) that are similar: sketches rule out most, and only texts of the others have their sets read."""
    low = threshold - 0.00005
    one, two = (texts.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("k").alias(f"k_{c}")) for c in "ab")
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            differ = []
            for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                size = min(len(x), len(y)) // 8
                differ.append(int(np.bitwise_count(_folded(np.frombuffer(x, dtype=np.uint64), size) ^ _folded(np.frombuffer(y, dtype=np.uint64), size)).sum()))
            total = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(np.array(differ, dtype=np.int64) <= _apart(total, low)))

    both = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "n_a", "n_b", "k_a", "k_b")
    pairs = scratch.save(both.mapInArrow(run, f"a {kind}, b {kind}"), "likely")
    sets = _sets_of(scratch, rows, texts, pairs.select(F.explode(F.array("a", "b")).alias("rep")))
    own, other = sets.select(F.col("rep").alias("a"), F.col("s").alias("s_a")), sets.select(F.col("rep").alias("b"), F.col("s").alias("s_b"))
    found = scratch.save(pairs.join(own, "a").join(other, "b").filter(jaccard(F.col("s_a"), F.col("s_b")) >= threshold).select("a", "b"), name)
    scratch.drop("likely", "wanted", "sets")
    return found


def _paired_by_ids(rows: DataFrame, threshold: float) -> DataFrame:
    """Texts (a, b) of one bucket and two components that can be similar; ``rows`` holds key, rep, n, at, component and the bucket's main one.

    What two texts have in common is the prefix shingles they share and, at
    most, all that follows the last of these in both orders.
    """
    low, least = threshold - 0.00005, round(threshold * 10_000)
    one, two = (rows.select("key", "main", *[F.col(c).alias(f"{c}_{side}") for c in ("rep", "n", "at", "component")]) for side in "xy")
    near = F.least("n_x", "n_y") * 10_001 >= F.greatest("n_x", "n_y") * least
    once = (F.col("component_y") == F.col("main")) | (F.col("rep_x") < F.col("rep_y"))
    met = one.filter("component_x <> main").join(two.drop("main"), "key").filter((F.col("component_x") != F.col("component_y")) & near & once)
    turned = F.col("rep_x") > F.col("rep_y")
    met = met.select(*[F.when(turned, F.col(f"{c}_{q}")).otherwise(F.col(f"{c}_{p}")).alias(f"{c}_{name}") for c in ("rep", "n", "at") for name, p, q in (("a", "x", "y"), ("b", "y", "x"))])
    shared = met.groupBy("rep_a", "rep_b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("c"), F.max("at_a").alias("at_a"), F.max("at_b").alias("at_b"))
    most = F.col("c") + F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) - 1
    return shared.filter(most * (1 + low) >= low * (F.col("n_a") + F.col("n_b")) - 1e-6).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))


def _similar(scratch: Scratch, rows: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Components (node, component) of texts that are similar, through others or not."""
    keys = texts.select("rep", "n", F.explode(F.arrays_zip("prefix", "places")).alias("k")).select("rep", "n", F.col("k.prefix").alias("key"), F.col("k.places").alias("at"))
    leads = keys.groupBy("key").agg(F.min("rep").alias("lead"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    members = scratch.save(keys.join(leads, "key"), "members")
    # One comparison a text: with the lead of most of its buckets.
    tried = members.filter("rep <> lead").groupBy("rep", "lead").agg(F.count(F.lit(1)).alias("n")).groupBy("rep").agg(F.max_by("lead", F.struct("n", "lead")).alias("lead"))
    links = _confirmed(scratch, rows, texts, tried.select(F.col("rep").alias("a"), F.col("lead").alias("b")), threshold, "links")

    def mixed() -> tuple[DataFrame, DataFrame]:
        """Members with their component so far, and the buckets with several components: main, number of texts beside it."""
        found = connected_components(links, "duplicates")
        placed = members.select("key", "rep", "n", "at", "members").join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        scratch.drop("placed", "mixed")
        placed = scratch.save(placed, "placed")
        held = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("held")).groupBy("key").agg(F.max_by("component", F.struct("held", "component")).alias("main"), (F.sum("held") - F.max("held")).alias("others"), F.count(F.lit(1)).alias("parts"))
        return placed, scratch.save(held.filter("parts > 1").select("key", "main", "others"), "mixed")

    placed, several = mixed()
    links = links.unionByName(_confirmed(scratch, rows, texts, _paired_by_ids(placed.join(several.filter(F.col("others") <= FEW), "key"), threshold), threshold))
    if several.filter(F.col("others") > FEW).isEmpty():
        return connected_components(links, "duplicates")
    kind, least, low = texts.schema["rep"].dataType.simpleString(), round(threshold * 10_000), threshold - 0.00005

    def blocks(hot: DataFrame, size: int, *columns: str) -> DataFrame:
        """Texts of buckets in pairs of blocks; hot: key, rep, component, members."""
        hot = hot.withColumn("parts", F.ceil(F.col("members") / size).cast("bigint"))
        return _paired(hot, "key", F.pmod(F.xxhash64("rep"), F.col("parts")), F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).select("key", "p", "q", "side", "rep", "component", *columns)

    def by_sketches() -> tuple[DataFrame, DataFrame]:
        """Members of the buckets with many texts beside their largest component, and the same in pairs of blocks with sketches."""
        placed, several = mixed()
        hot = placed.select("key", "rep", "component", "members").join(several.filter(F.col("others") > FEW).select("key"), "key")
        return hot, blocks(hot.join(texts.select("rep", "n", "k"), "rep"), SKETCHES, "n", "k")

    # What joins components by sketches mostly does by sets, too; what the others hid is found below.
    pairs = by_sketches()[1].mapInArrow(lambda batches: _near(batches, low, least, True), f"a {kind}, b {kind}").distinct()
    links = links.unionByName(_confirmed(scratch, rows, texts, pairs, threshold))
    hot, placed = by_sketches()
    wanted = scratch.save(placed.mapInArrow(lambda batches: _near(batches, low, least, False), f"key bigint, rep {kind}").distinct(), "near")
    sizes = wanted.groupBy("key").agg(F.count(F.lit(1)).alias("members"))
    rest = hot.drop("members").join(wanted, ["key", "rep"]).join(sizes, "key").join(_sets_of(scratch, rows, texts, wanted), "rep")
    more = scratch.save(blocks(rest, BLOCK, "s").mapInArrow(lambda batches: _forest(batches, least), f"a {kind}, b {kind}"), "more")
    scratch.drop("wanted", "sets", "near")
    return connected_components(links.unionByName(more), "duplicates")


def _lowest_similarity(scratch: Scratch, inside: DataFrame, sets: DataFrame) -> DataFrame:
    """The lowest similarity of two texts of each cluster (cluster, lowest in ten-thousandths); ``inside`` holds rep and cluster."""
    kind = inside.schema["cluster"].dataType.simpleString()
    schema = f"cluster {kind}, lowest bigint"
    rows = inside.join(inside.groupBy("cluster").agg(F.count(F.lit(1)).alias("texts")), "cluster").join(sets.select("rep", "s"), "rep")
    rows = scratch.save(rows, "inside")
    zero = F.lit(0).cast("bigint")
    columns = ["cluster", "p", "q", "side", "s"]
    small = _paired(rows.filter(F.col("texts") <= BLOCK), "cluster", zero, F.array(zero)).select(columns).mapInArrow(_lowest, schema)
    large = rows.filter(F.col("texts") > BLOCK)
    if large.isEmpty():
        return small
    first = large.filter("rep = cluster").select("cluster", F.col("s").alias("s_0"))
    both = F.size(F.array_intersect("s", "s_0"))
    away = large.join(first, "cluster").withColumn("away", 1 - both / (F.size("s") + F.size("s_0") - both)).drop("s_0")
    away = scratch.save(away.withColumn("shell", F.least(F.floor(F.col("away") * SHELLS), F.lit(SHELLS - 1)).cast("bigint")), "away")
    # The farthest of all among themselves: no pair needs a look whose distances from the first text sum to less.
    far = away.withColumn("k", F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("away"), "rep"))).filter(F.col("k") <= BLOCK)
    bound = scratch.save(_paired(far, "cluster", zero, F.array(zero)).select(columns).mapInArrow(_lowest, schema), "bound")
    shells = away.groupBy("cluster", "shell").agg(F.count(F.lit(1)).alias("n"))
    blocks = shells.select("cluster", "shell", F.explode(F.sequence(zero, F.ceil(F.col("n") / BLOCK).cast("bigint") - 1)).alias("part"))
    number = lambda shell, part: shell * (1 << 40) + part
    every = blocks.groupBy("cluster").agg(F.collect_list(F.struct("shell", number(F.col("shell"), F.col("part")).alias("block"))).alias("blocks"))
    parts = shells.select("cluster", "shell", F.ceil(F.col("n") / BLOCK).cast("bigint").alias("parts"))
    rows = away.join(parts, ["cluster", "shell"]).join(every, "cluster").join(bound.withColumnRenamed("lowest", "upto"), "cluster")
    reach = 1 - (F.col("upto") + 1) / 10_000
    partners = F.transform(F.filter("blocks", lambda b: (b["shell"] + F.col("shell") + 2) / SHELLS >= reach), lambda b: b["block"])
    pairs = _paired(rows.withColumn("partners", partners), "cluster", number(F.col("shell"), F.pmod(F.xxhash64("rep"), F.col("parts"))), F.col("partners"))
    return small.unionByName(bound).unionByName(pairs.select(columns).mapInArrow(_lowest, schema)).groupBy("cluster").agg(F.min("lowest").alias("lowest"))


def find_duplicates(docs: DataFrame, threshold: float = 0.85, id_col: str = "doc_id", text_col: str = "text") -> Duplicates:
    """Clusters of two documents or more whose normalised texts are equal or similar, directly or through others.

    Equal normalised texts collapse first.  The similarity is the lowest over
    all pairs of a cluster, half-even to four places; a null text is empty, and
    empty texts are equal.  Members come as rows, however many a cluster has.
    """
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "duplicates")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), normalize_text(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"))
    rows = scratch.save(rows.select("row", "id", F.sha2("norm", 256).alias("hash"), F.transform(F.filter(F.split("norm", " "), lambda w: w != ""), lambda w: F.xxhash64(w)).alias("w")), "rows")
    whole = _rarity_ordered(scratch, rows, threshold)
    found = scratch.save(_similar(scratch, rows, whole, threshold), "components")
    scratch.drop("members", "placed", "mixed")
    inside = found.select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    sets = _sets_of(scratch, rows, whole, inside)
    rows, texts = scratch.save(rows.select("id", "hash"), "ids"), scratch.save(whole.select("hash", "rep", "copies"), "reps")
    scratch.drop("wanted", "rows", "texts")
    lowest = scratch.save(_lowest_similarity(scratch, inside, sets), "lowest")
    scratch.drop("sets", "inside", "away", "bound")
    own = texts.join(inside, "rep", "left").withColumn("cluster", F.coalesce("cluster", "rep"))
    sizes = own.groupBy("cluster").agg(F.sum("copies").alias("size")).filter("size > 1")
    similarity = F.coalesce((F.col("lowest").cast("decimal(12,0)") / 10_000).cast("decimal(6,4)"), F.lit(1).cast("decimal(6,4)"))
    clusters = scratch.save(sizes.join(lowest, "cluster", "left").select("cluster", "size", similarity.alias("similarity"), (similarity == 1).alias("exact")), "clusters")
    members = rows.select("id", "hash").join(own.select("hash", "cluster"), "hash").join(clusters.select("cluster"), "cluster", "left_semi").select("cluster", "id")
    return Duplicates(clusters, members)


def duplicate_clusters(docs: DataFrame, threshold: float = 0.85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Clusters with their members listed: cluster, ids, similarity, exact.  For reports; ``find_duplicates`` gives members as rows."""
    found = find_duplicates(docs, threshold, id_col, text_col)
    listed = found.members.groupBy("cluster").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return listed.join(found.clusters.drop("size"), "cluster").select("cluster", "ids", "similarity", "exact")


def duplicate_issues(clusters: DataFrame) -> DataFrame:
    """DUPLICATE_CONTENT and NEAR_DUPLICATE_CONTENT findings, one per cluster."""
    return clusters.select(
        F.col("cluster").alias("page_id"), F.when(F.col("exact"), "DUPLICATE_CONTENT").otherwise("NEAR_DUPLICATE_CONTENT").alias("code"),
        F.lit("Medium").alias("severity"), F.lit("Content").alias("category"), F.array_join(F.transform("ids", lambda i: i.cast("string")), ", ").alias("detail"),
    )
