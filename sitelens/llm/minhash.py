"""Near-duplicate documents by HyperMinHash.

The distinct shingles of a document are hashed into 256 buckets; a bucket keeps
the leading-zero count of its smallest hash and the mantissa bits after it, two
bytes in all.  Empty buckets borrow from a filled one, by an order fixed for the
bucket, so that even a set of four shingles agrees in each register with
probability equal to its similarity.

1. Documents with the same set form a class; only its smallest id goes on.
2. Bands of compressed registers are the candidate buckets.  First each member
   is compared with two of each of its buckets only, the smallest id and the
   member with the most neighbours: candidates grow with the documents, not
   with the square of a bucket.
3. Candidates are screened by the collision-corrected estimate of their
   similarity and confirmed on full shingle sets.
4. Where a bucket still holds several components, its members are compared
   across them in blocks of bounded size.  Each document has one home block,
   taken from its largest bucket; two blocks meet once, however many buckets
   their members share.  They meet by two bits of each register first; only
   members with a partner that agrees in enough of them meet again with their
   sets, and hand on a spanning forest of the links they find.  No link that
   joins two components is left out, and no pairs are listed.

A pair at similarity 0.75 misses all 51 bands of 5 registers with probability
1e-6; both screens lie five standard errors below the threshold.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.groups import groups
from ..plans.durable import Scratch, small_batches
from .bits import among
from .documents import by_id, keyed
from .words import Words, mix, pieces, split, texts_of

BUCKETS, MANTISSA, ROWS = 256, 10, 5
BANDS = BUCKETS // ROWS
SHINGLE = 5
#: Link where 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Estimates from 256 registers have a standard error of 0.027 at 0.75.
SCREEN = 0.6
#: Registers whose two bits agree: 208 of 256 at 0.75, with a standard error of 6.2; the pairs missed are no more than by SCREEN.
MARKED = 173
#: Documents of a home block; two of them are compared at a time.
BLOCK = 200
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_orders: list[np.ndarray] = []


def shingle_sets(words: Words) -> list[np.ndarray]:
    """Of each text, sorted 64-bit hashes of its distinct 5-word shingles; all words as one where there are fewer."""
    h = words.hashes
    n = max(len(h) - SHINGLE + 1, 0)
    s = h[:n].copy()
    for i in range(1, SHINGLE):
        s = s * _FACTOR + h[i : i + n]
    s = mix(s)
    found = []
    for a, b in itertools.pairwise(words.first.tolist()):
        if b - a >= SHINGLE:
            found.append(np.unique(s[a : b - SHINGLE + 1]))
        elif b > a:
            short = np.uint64(b - a)
            for x in h[a:b]:
                short = short * _FACTOR + x
            found.append(mix(np.array([short])))
        else:
            found.append(np.array([], dtype=np.uint64))
    return found


def shingle_set(text: str | None) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass") if text else b"", dtype=np.uint8)
    return shingle_sets(split(data, np.array([0, len(data)]), lower=True))[0]


def registers(shingles: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of sorted hashes; buckets without a hash borrow."""
    top = shingles >> np.uint64(56)
    filled, first = np.unique(top, return_index=True)  # sorted: the first of a bucket is its smallest
    rest = (shingles[first] << np.uint64(8)) >> np.uint64(11)
    zeros = 53 - np.frexp(rest.astype(np.float64))[1]
    mantissa = ((rest << zeros.astype(np.uint64)) >> np.uint64(52 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)
    values = (zeros.astype(np.uint16) << MANTISSA) | mantissa.astype(np.uint16)
    if len(filled) == BUCKETS:
        return values
    if not _orders:
        rng = np.random.default_rng(20_03)
        _orders.append(np.argsort(rng.random((BUCKETS, BUCKETS)), axis=1).astype(np.uint8))
    bins = filled.astype(np.int64)
    out = np.empty(BUCKETS, dtype=np.uint16)
    out[bins] = values
    empty = np.setdiff1d(np.arange(BUCKETS), bins, assume_unique=True)
    out[empty] = values[np.argmin(_orders[0][empty][:, bins], axis=1)]
    return out


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Similarity of register rows, corrected for registers that agree by chance."""
    level = 0.5 ** np.arange(1, 54)

    def share(n: np.ndarray) -> np.ndarray:  # of a bucket's smallest hash: the chance of each leading-zero count
        per = np.maximum(n / BUCKETS, 1.0)[:, None]
        return (1 - level) ** per - (1 - np.minimum(1.0, 2 * level)) ** per

    chance = (share(n_a) * share(n_b)).sum(axis=1) / (1 << MANTISSA)
    return ((a == b).mean(axis=1) - chance) / (1 - chance)


def sketches(texts: DataFrame) -> DataFrame:
    """Of texts (id, body): id, n (size of the set), digest of the whole set, regs (null where no other set can be similar)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1):
                n, digests, regs = [], [], []
                for found in shingle_sets(split(*texts_of(part.column(1)), lower=True)):
                    n.append(len(found))
                    digests.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                    regs.append(registers(found).astype("<u2").tobytes() if len(found) > 2 else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(regs, pa.binary())], ["id", "n", "digest", "regs"]
                )

    return texts.mapInArrow(run, "id bigint, n bigint, digest binary, regs binary")


def _screened(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) with their estimate, where it reaches the screen and the sizes allow a link."""
    side = reps.select("id", "n", "regs")
    both = (
        pairs.join(side.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("regs").alias("regs_b")), "b")
        .join(side.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("regs").alias("regs_a")), "a")
        .filter(100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype="<u2").reshape(-1, BUCKETS) for i in (2, 3))
            found = estimate(a, b, *(batch.column(i).to_numpy().astype(np.float64) for i in (4, 5)))
            keep = pa.array(found >= SCREEN)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], ["a", "b", "est"]).filter(keep)

    return both.select("a", "b", "regs_a", "regs_b", "n_a", "n_b").mapInArrow(run, "a bigint, b bigint, est double")


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) that are linked, from the full sets of both texts (id, body)."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = among(texts, "id", ends).join(ends, "id", "left_semi")
    both = (
        pairs.select("a", "b")
        .join(texts.select(F.col("id").alias("a"), F.col("body").alias("body_a")), "a")
        .join(texts.select(F.col("id").alias("b"), F.col("body").alias("body_b")), "b")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str | None, np.ndarray] = (None, np.array([], dtype=np.uint64))
        for batch in batches:
            keep = []
            for text_a, text_b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if text_b != last[0]:
                    last = (text_b, shingle_set(text_b))
                a, b = shingle_set(text_a), last[1]
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * common >= PERCENT * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "body_a", "body_b").mapInArrow(run, "a bigint, b bigint")


def _across_components(scratch: Scratch, across: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between components that share buckets: across has bucket, id, component."""
    sizes = across.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    largest = across.join(sizes, "bucket").groupBy("id").agg(F.max_by("bucket", F.struct("size", "bucket")).alias("own"), F.min("component").alias("component"))
    largest = scratch.save(largest, "largest")
    parts = largest.groupBy("own").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    homes = largest.join(parts, "own").select("id", "component", F.xxhash64("own", F.pmod(F.xxhash64("id"), F.col("parts"))).alias("home"))
    homes = scratch.save(homes, "homes")
    # Which blocks meet: those with members of different components in one bucket.
    inside = across.select("bucket", "id").join(homes, "id").groupBy("bucket", "home").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    inside = scratch.save(inside, "inside")
    x, y = inside.alias("x"), inside.alias("y")
    differ = F.least("x.lo", "y.lo") < F.greatest("x.hi", "y.hi")
    meet = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.home") <= F.col("y.home")) & differ).select(F.col("x.home").alias("p"), F.col("y.home").alias("q")).distinct()
    meet = scratch.save(meet, "meet")

    light = scratch.save(homes.join(reps.select("id", "n", "regs"), "id").mapInArrow(_marked, "id bigint, home bigint, component bigint, n bigint, marks binary"), "light")
    asked = scratch.save(_meeting(meet, light, ["id", "component", "n", "marks"]).mapInArrow(_alike_members, "p bigint, q bigint, side int, id bigint, marks binary"), "asked")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1):
                found = [x.tobytes() for x in shingle_sets(split(*texts_of(part.column(1)), lower=True))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], ["id", "shingles"])

    ids = asked.select("id").distinct()
    wanted = among(texts, "id", ids).join(ids, "id", "left_semi").mapInArrow(sets, "id bigint, shingles binary")
    full = scratch.save(homes.select("id", "component").join(wanted, "id"), "full")
    blocks = asked.join(full, "id").select("p", "q", "side", "id", "component", "marks", "shingles").repartition("p", "q").sortWithinPartitions("p", "q", "side")
    return blocks.mapInArrow(_linked_blocks, "a bigint, b bigint")


def _meeting(meet: DataFrame, members: DataFrame, columns: list[str]) -> DataFrame:
    """Members of the blocks p (side 0) and q (side 1), the rows of each pair of blocks together."""
    left = meet.join(members, meet["p"] == members["home"]).withColumn("side", F.lit(0))
    right = meet.filter("p < q").join(members, F.col("q") == F.col("home")).withColumn("side", F.lit(1))
    columns = ["p", "q", "side", *columns]
    return left.select(*columns).unionByName(right.select(*columns)).repartition("p", "q").sortWithinPartitions("p", "q", "side")


def marks(regs: np.ndarray) -> np.ndarray:
    """Two bits of each register, mixed with its place: of each row the first bits (four words), then the second ones."""
    h = mix(regs.astype(np.uint64) + (np.arange(BUCKETS, dtype=np.uint64) << np.uint64(16)))
    return np.packbits(np.concatenate((h & np.uint64(1), (h >> np.uint64(1)) & np.uint64(1)), axis=1).astype(bool), axis=1).view("<u8")


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers both of whose bits agree; never fewer than registers that agree."""
    differ, half = a ^ b, a.shape[-1] // 2
    return BUCKETS - np.bitwise_count(differ[..., :half] | differ[..., half:]).sum(axis=-1, dtype=np.int64)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        regs = np.frombuffer(b"".join(batch.column("regs").to_pylist()), dtype="<u2").reshape(-1, BUCKETS)
        columns = ["id", "home", "component", "n"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array([x.tobytes() for x in marks(regs)], pa.binary())], [*columns, "marks"])


def _alike_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each pair of blocks, members with a partner in another component whose size and marks allow a link."""
    for rows in groups(batches, ["p", "q"]):
        side, component, n = (rows[c].to_numpy() for c in ("side", "component", "n"))
        bits = np.frombuffer(b"".join(rows["marks"].to_pylist()), dtype="<u8").reshape(len(n), -1)
        one_block = not side.any()
        found = np.zeros(len(n), dtype=bool)
        for i in np.flatnonzero(side == 0):
            others = np.arange(i + 1, len(n)) if one_block else np.flatnonzero(side == 1)
            others = others[(component[others] != component[i]) & (100 * np.minimum(n[others], n[i]) >= PERCENT * np.maximum(n[others], n[i]))]
            others = others[agreeing(bits[others], bits[i]) >= MARKED]
            found[others] = True
            found[i] |= len(others) > 0
        if found.any():
            yield from rows.select(["p", "q", "side", "id", "marks"]).filter(pa.array(found)).combine_chunks().to_batches()


def _linked_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each pair of blocks, links that join components: as many as it takes, no more."""
    for rows in groups(batches, ["p", "q"]):
        ids, side, component = (rows[c].to_numpy() for c in ("id", "side", "component"))
        sets = [np.frombuffer(x, dtype=np.uint64) for x in rows["shingles"].to_pylist()]
        n = np.array([len(x) for x in sets])
        bits = np.frombuffer(b"".join(rows["marks"].to_pylist()), dtype="<u8").reshape(len(n), -1)
        joined = component.copy()
        one_block = not side.any()
        a, b = [], []
        for i in np.flatnonzero(side == 0):
            others = np.arange(i + 1, len(ids)) if one_block else np.flatnonzero(side == 1)
            others = others[(joined[others] != joined[i]) & (100 * np.minimum(n[others], n[i]) >= PERCENT * np.maximum(n[others], n[i]))]
            others = others[agreeing(bits[others], bits[i]) >= MARKED]
            for j in others:
                if joined[i] == joined[j]:
                    continue
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * common >= PERCENT * (n[i] + n[j] - common):
                    a.append(ids[i])
                    b.append(ids[j])
                    joined[joined == joined[j]] = joined[i]
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of 0.75 or more.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.  Returns a row per
    document: ``id_col``, n_shingles, component_id (smallest id reachable by
    links, itself included), kept (id = component_id).

    * null text, or no words: an empty set, linked with nothing;
    * under five words: the whole sequence is the only shingle;
    * rows that repeat an id and its text count as one document and each row is
      returned; different texts under one id are documents of their own; a null
      id gives a row with a null component_id that is not kept and links nothing;
    * ties: the smallest id leads a component; very long texts count whole;
    * empty table: empty result; other columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "minhash")
    named, texts = keyed(scratch, docs, id_col, text_col)
    texts = texts.select(F.when(F.col("id").isNotNull(), F.col("doc")).alias("id"), "body")
    sketch = scratch.save(sketches(texts), "sketches")
    classes = scratch.save(
        sketch.filter("digest is not null and id is not null").groupBy("digest").agg(F.min("id").alias("rep")), "classes"
    )
    reps = scratch.save(
        sketch.filter("regs is not null").join(classes.select(F.col("rep").alias("id")), "id", "left_semi").dropDuplicates(["id"]).select("id", "n", "regs"),
        "reps",
    )
    bands = reps.select(
        "id", F.posexplode(F.array(*[F.substring("regs", 1 + 2 * ROWS * i, 2 * ROWS) for i in range(BANDS)]))
    ).select("id", F.xxhash64("pos", "col").alias("bucket"))
    leads = bands.groupBy("bucket").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    members = scratch.save(bands.join(leads, "bucket"), "members")
    # Most texts share no bucket; the registers of the others are all that is read from here on.
    near = scratch.save(among(reps, "id", members.select("id")), "near")
    # The member with the most neighbours over all its buckets is the likeliest original of the others.
    weight = members.groupBy("id").agg(F.sum("members").alias("weight"))
    centres = members.join(weight, "id").groupBy("bucket").agg(F.max_by("id", F.struct("weight", -F.col("id"))).alias("centre"))
    stars = members.join(centres, "bucket").select("id", F.explode(F.array("lead", "centre")).alias("b")).filter("id <> b").select(F.col("id").alias("a"), "b").distinct()
    # One confirmation a document: with the lead or centre most like it.
    best = _screened(stars, near).groupBy("a").agg(F.max_by("b", F.struct("est", -F.col("b"))).alias("b"))
    tried = scratch.save(best, "tried")
    links = scratch.save(_confirmed(tried, texts), "links")
    found = scratch.save(connected_components(links), "components")
    # What still lies in one bucket but in several components.
    placed = members.join(found.withColumnRenamed("node", "id"), "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("bucket")
    across = scratch.save(placed.join(mixed, "bucket"), "across")
    more = scratch.save(_across_components(scratch, across, near, texts), "more")
    scratch.drop("reps", "members", "near", "tried", "across", "largest", "homes", "inside", "meet", "light", "asked", "full")
    if not more.isEmpty():
        found = connected_components(links.unionByName(more))
    of_class = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    found = sketch.select("id", "n", "digest").join(of_class, "digest", "left").select("id", "n", F.coalesce("component", "id").alias("component"))
    if by_id(docs, id_col):
        rows = found.select("id", "n", "component", F.col("id").alias("own"))
    else:  # from document numbers back to ids; the numbers follow the ids, so the smallest stays the smallest
        keys = named.select("id", "doc").distinct()
        lead = keys.select(F.col("doc").alias("component"), F.col("id").alias("lead"))
        numbers = found.filter("id is not null").withColumnRenamed("id", "doc").join(lead, "component").select("doc", "n", F.col("lead").alias("component"))
        rows = named.filter("id is not null").select("id", "doc").join(numbers, "doc").select("id", "n", "component", F.col("id").alias("own"))
        nameless = named.filter("id is null").select(F.lit(None).cast("bigint").alias("id"), "body")
        counted = sketches(nameless).select(F.lit(None).cast(dict(named.dtypes)["id"]).alias("id"), "n", F.lit(None).cast(dict(named.dtypes)["id"]).alias("component"), F.lit(None).cast(dict(named.dtypes)["id"]).alias("own"))
        rows = rows.unionByName(counted)
    return rows.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
        F.coalesce(F.col("own") == F.col("component"), F.lit(False)).alias("kept"),
    )

