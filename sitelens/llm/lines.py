"""Line deduplication by an exact set-similarity join.

A line is the set of its words.  The words of a line are ordered by rarity, the
rarest first; two sets of similarity 0.75 share a word in their prefixes (the
first n - ceil(0.75 n) + 1 words), so prefixes are all that is joined.

1. Equal sets are one class, led by the first of its lines, so copies make no
   pairs.
2. Each word of a class's prefix is a posting.  Postings travel packed, many to
   a row, to the block of their word; words with very many postings are split
   over pairs of blocks.  In a block, two postings of a word go on if the sizes
   allow the similarity (length filter), the words left behind the shared one
   can still make up the overlap (positional filter), and the 128-bit parities
   of the sets don't differ in more bits than the sets may differ in words.
3. Pairs aren't listed.  Of each posting only the earlier partner that seems
   most similar is handed on, and of each line only the best of those is verified on
   the whole lines; that settles nearly all lines that have a match.
4. A line that isn't settled but had other partners meets all of them once more
   in blocks, by word, with the whole lines at hand.

Any order of words that is the same for all lines keeps the join exact.  Words
are ranked by the counts of their hash buckets over all texts, then by hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.groups import groups
from ..plans.durable import Scratch, small_batches
from .bits import bit_table, hits
from .documents import keyed
from .words import mix, pieces, split, texts_of

#: Lines match where 100 * common words >= PERCENT * all words.
PERCENT = 75
#: Hash buckets that words are counted by (bits); their ranks, four bytes each, go to every executor.
RANK_BITS = 20
#: Postings of a block, about; a word with more of them is split over pairs of blocks.
POSTINGS = 100_000
#: Lines of one word that are compared whole at a time.
LINES = 4_000
#: Pairs looked at together, and postings packed together.
PAIRS, PACKED = 1 << 18, 1 << 17
#: Lists of kept lines are broadcast up to this size, and removed lines up to this number (16 bytes each).
BROADCAST_BYTES, BROADCAST_ROWS = 32 << 20, 500_000
_KEY_BITS = 40
_KEY = np.uint64((1 << _KEY_BITS) - 1)
_OTHER = np.uint64(0x9E3779B97F4A7C15)
#: Columns of a packed block of postings.
_COLUMNS = (("key", "<u4"), ("low", "<u8"), ("high", "<u8"), ("doc", "<i8"), ("line", "<u4"), ("n", "<u4"), ("pos", "<u4"), ("side", "u1"))
#: Of these, the columns of hash bits, which don't compress.
_HASHED = ("key", "low", "high")
PLACE = ["doc", "line"]


# Counts by hash bucket


def _counted(keys_of, bits: int):
    """Counts of the keys of a whole task by bucket, as blocks of 4096 buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, dtype=np.int64)
        for batch in batches:
            for keys in keys_of(batch):
                counts += np.bincount(keys, minlength=len(counts))
        blocks = counts.reshape(-1, 4096)
        some = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([blocks[i].tobytes() for i in some], pa.binary())], ["block", "counts"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[block] = total.get(block, 0) + np.frombuffer(counts, dtype=np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["block", "counts"])


def bucket_counts(rows: DataFrame, keys_of, bits: int = RANK_BITS) -> np.ndarray:
    """Keys in each of a fixed number of buckets; ``keys_of`` gives the buckets of a batch's keys."""
    parts = rows.mapInArrow(_counted(keys_of, bits), "block bigint, counts binary")
    counts = np.zeros(((1 << bits) // 4096, 4096), dtype=np.int64)
    for r in parts.repartition("block").mapInArrow(_summed, "block bigint, counts binary").collect():
        counts[r["block"]] = np.frombuffer(r["counts"], dtype=np.int64)
    return counts.ravel()


def _word_buckets(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for part in pieces(batch, 0):
        yield (split(*texts_of(part.column(0)), lower=True).hashes >> np.uint64(64 - RANK_BITS)).astype(np.int64)


# Sets of lines


def line_sets(docs: np.ndarray, data: np.ndarray, offsets: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of lines with words: doc, line, two digests and the size of the set, its parities, and its prefix as word keys."""
    words = split(data, offsets, lower=True)
    ends = np.flatnonzero(data == 10)
    above = np.searchsorted(ends, words.start)  # line ends before each word, and before its text
    number = above - np.searchsorted(ends, offsets[:-1])[words.text]
    owner = above + words.text
    new = np.concatenate(([True], owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, dtype=bool)
    owner = np.cumsum(new) - 1
    lines = np.flatnonzero(new)
    h = words.hashes
    rank = ranks[(h >> np.uint64(64 - RANK_BITS)).astype(np.int64)].astype(np.uint64)
    # By rank, then by the low bits of the hash: one number holds line, rank and bits.
    low_bits = h & np.uint64((1 << 24) - 1)
    code = (owner.astype(np.uint64) << np.uint64(44)) | (rank << np.uint64(24)) | low_bits
    order = np.argsort(code)
    tied = (code[order][1:] == code[order][:-1]) & (h[order][1:] != h[order][:-1])
    if len(lines) >= 1 << 20 or tied.any():  # it doesn't tell all words apart: then by the whole hash
        order = np.lexsort((h, low_bits, rank, owner))
    sorted_owner, hs = owner[order], h[order]
    distinct = np.concatenate(([True], (hs[1:] != hs[:-1]) | (sorted_owner[1:] != sorted_owner[:-1]))) if len(hs) else np.zeros(0, dtype=bool)
    hs, sorted_owner = hs[distinct], sorted_owner[distinct]
    n = np.bincount(sorted_owner, minlength=len(lines))
    first = np.cumsum(n) - n
    if not len(lines):
        none = np.zeros(0, dtype=np.uint64)
        return docs[:0], number, none, none, n, none, none, none, n
    mixed = mix(hs)
    one = np.uint64(1) << (mixed >> np.uint64(58))
    half = (mixed >> np.uint64(57)) & np.uint64(1)
    prefix = n - -(-PERCENT * n // 100) + 1
    short = np.arange(len(hs)) - first[sorted_owner] < prefix[sorted_owner]
    return (
        docs[words.text[lines]], number[lines], np.add.reduceat(mixed, first), np.add.reduceat(mix(hs + _OTHER), first), n,
        np.bitwise_xor.reduceat(one * (np.uint64(1) - half), first), np.bitwise_xor.reduceat(one * half, first), hs[short] & _KEY, prefix,
    )


def _bytes5(keys: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])


def _keys5(data: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(data) // 5, 8), dtype=np.uint8)
    wide[:, :5] = data.reshape(-1, 5)
    return wide.view("<u8").ravel()


_SET = "doc bigint, line bigint, d1 bigint, d2 bigint, n bigint, low bigint, high bigint, prefix binary"


def _sets(sent: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1):
                docs, lines, d1, d2, n, low, high, keys, sizes = line_sets(part.column(0).to_numpy(), *texts_of(part.column(1)), sent.value)
                at = np.concatenate(([0], np.cumsum(5 * sizes))).astype(np.int32)
                prefix = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(_bytes5(keys))])
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64) if x.dtype == np.uint64 else x, pa.int64()) for x in (docs, lines, d1, d2, n, low, high)] + [prefix], ["doc", "line", "d1", "d2", "n", "low", "high", "prefix"])

    return run


# Postings


def _prefix_keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a column of prefixes, and how many each has."""
    data, offsets = texts_of(column)
    return _keys5(data), np.diff(offsets) // 5


def _key_buckets(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    yield (_prefix_keys(batch.column(0))[0] >> np.uint64(_KEY_BITS - RANK_BITS)).astype(np.int64)


def pack(columns: dict[str, np.ndarray]) -> bytes:
    """Columns one after the other behind their length: hash bits as they are, the others byte plane by byte plane, compressed."""
    plain, planes = [], []
    for name, kind in _COLUMNS:
        x = columns[name].astype(kind)
        if name in _HASHED:
            plain.append(x.tobytes())
        else:
            planes.append(x.view(np.uint8).reshape(len(x), -1).T.tobytes())
    packed = pa.Codec("zstd", 1).compress(b"".join(planes), asbytes=True)
    return b"".join([len(columns["key"]).to_bytes(8, "little"), *plain, packed])


def unpack(data: bytes) -> dict[str, np.ndarray]:
    m, at, out = int.from_bytes(data[:8], "little"), 8, {}
    for name in _HASHED:
        kind = np.dtype(dict(_COLUMNS)[name])
        out[name] = np.frombuffer(data, dtype=kind, count=m, offset=at)
        at += kind.itemsize * m
    rest = [(name, np.dtype(kind)) for name, kind in _COLUMNS if name not in _HASHED]
    flat = np.frombuffer(pa.Codec("zstd").decompress(data[at:], decompressed_size=m * sum(k.itemsize for _, k in rest), asbytes=True), dtype=np.uint8)
    at = 0
    for name, kind in rest:
        planes = flat[at : at + kind.itemsize * m].reshape(kind.itemsize, m)
        out[name] = np.ascontiguousarray(planes.T).view(kind).ravel()
        at += kind.itemsize * m
    return out


def _packed(counts: Broadcast, n_blocks: int, limit: int):
    """Rows (block, postings) of classes; a word beyond the limit goes to pairs of parts of its classes."""

    def blocks_of(held: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        p = {name: np.concatenate([x[name] for x in held]) for name in held[0]}
        many = counts.value[(p["key"] >> np.uint64(_KEY_BITS - RANK_BITS)).astype(np.int64)]
        alone = many < 2
        parts = np.where(many > limit, -(-many // limit), 1)
        own = (mix(p["doc"].view(np.uint64) * _OTHER + p["line"].astype(np.uint64)) % parts.astype(np.uint64)).astype(np.int64)
        row = np.repeat(np.flatnonzero(~alone), parts[~alone])
        other = np.arange(len(row)) - np.repeat(np.cumsum(parts[~alone]) - parts[~alone], parts[~alone])
        i = own[row]
        p = {name: x[row] for name, x in p.items()}
        p["side"] = np.where(i == other, 0, np.where(i < other, 1, 2)).astype(np.uint8)
        block = (p["key"] % np.uint64(n_blocks)).astype(np.int64)
        hot = parts[row] > 1
        a, b = np.minimum(i, other)[hot].astype(np.uint64), np.maximum(i, other)[hot].astype(np.uint64)
        block[hot] = n_blocks + (mix(mix(p["key"][hot] + a * _OTHER) + b) >> np.uint64(2)).astype(np.int64)
        # The block tells the low bits of a word's key; the others fit four bytes but for a few that meet by chance.
        p["key"] = (p["key"] >> np.uint64(n_blocks.bit_length() - 1)) & np.uint64((1 << 32) - 1)
        order = np.argsort(block, kind="stable")
        cuts = np.flatnonzero(np.diff(block[order], prepend=-1)) if len(order) else np.zeros(0, dtype=np.int64)
        ends = np.append(cuts[1:], len(order))
        for s in range(0, len(cuts), 200):
            spans = [order[x:y] for x, y in zip(cuts[s : s + 200], ends[s : s + 200], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(block[[x[0] for x in spans]]), pa.array([pack({name: x[span] for name, x in p.items()}) for span in spans], pa.binary())], ["block", "postings"]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        for batch in batches:
            docs, lines, n, low, high = (batch.column(k).to_numpy() for k in range(5))
            keys, sizes = _prefix_keys(batch.column(5))
            owner = np.repeat(np.arange(len(sizes)), sizes)
            pos = np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            held.append({"key": keys, "doc": docs[owner], "line": lines[owner], "n": n[owner], "pos": pos, "low": low.view(np.uint64)[owner], "high": high.view(np.uint64)[owner]})
            if sum(len(x["key"]) for x in held) >= PACKED:
                yield from blocks_of(held)
                held = []
        if held:
            yield from blocks_of(held)

    return run


def near_postings(p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one block: postings with a partner that passes all filters, the best earlier one (-1: none), how far it lies from the threshold, and the number of earlier ones."""
    span = np.uint64((1 << 24) - 1)
    p = p | {"key": p["key"].astype(np.uint64)}
    order = np.argsort((p["key"] << np.uint64(24)) | np.minimum(p["n"].astype(np.uint64), span), kind="stable")
    p = {name: x[order] for name, x in p.items()}
    m = len(order)
    n, pos = p["n"].astype(np.int64), p["pos"].astype(np.int64)
    code = (p["key"] << np.uint64(24)) | np.minimum(p["n"].astype(np.uint64), span)
    upper = np.searchsorted(code, (p["key"] << np.uint64(24)) | np.minimum((n * 100 // PERCENT).astype(np.uint64), span), "right")
    partners = np.maximum(upper - np.arange(m) - 1, 0)
    age = np.empty(m, dtype=np.int64)
    age[np.lexsort((p["line"], p["doc"]))] = np.arange(m)
    best = np.full(m, np.iinfo(np.int64).max)
    earlier = np.zeros(m, dtype=np.int64)
    near = np.zeros(m, dtype=bool)
    stops = np.cumsum(partners)
    at = 0
    while at < m:
        to = max(at + 1, int(np.searchsorted(stops, (stops[at - 1] if at else 0) + PAIRS, "right")))
        size = partners[at:to]
        x = np.repeat(np.arange(at, to), size)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size)
        both = n[x] + n[y]
        behind = np.minimum(n[x] - pos[x], n[y] - pos[y])
        fits = ((100 + PERCENT) * behind >= PERCENT * both) & ((p["side"][x] + p["side"][y] == 3) | (p["side"][x] + p["side"][y] == 0)) & (100 * n[x] >= PERCENT * n[y])
        x, y, both = x[fits], y[fits], both[fits]
        differ = (np.bitwise_count(p["low"][x] ^ p["low"][y]) + np.bitwise_count(p["high"][x] ^ p["high"][y])).astype(np.int64)
        fits = ((100 + PERCENT) * differ <= (100 - PERCENT) * both) & ((p["doc"][x] != p["doc"][y]) | (p["line"][x] != p["line"][y]))
        x, y, differ = x[fits], y[fits], differ[fits]
        if len(x):
            near[x] = near[y] = True
            late = age[x] > age[y]
            later, first = np.where(late, x, y), np.where(late, y, x)
            # How far the pair lies from the threshold, as far as the parities tell; the oldest of equals.
            over = np.maximum((100 + PERCENT) * differ - (100 - PERCENT) * both[fits], -(1 << 21)) + (1 << 21)
            np.minimum.at(best, later, (over << 40) | age[first])
            earlier += np.bincount(later, minlength=m)
        at = to
    by_age = np.argsort(age)
    found = np.flatnonzero(near)
    some = best[found] < np.iinfo(np.int64).max
    partner = np.where(some, order[by_age[np.where(some, best[found] & ((1 << 40) - 1), 0)]], -1)
    return order[found], partner, np.where(some, best[found] >> 40, 0), earlier[found]


_NEAR = "key bigint, doc bigint, line bigint, e_doc bigint, e_line bigint, differ bigint, earlier bigint"


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in groups(batches, ["block"]):
        parts = [unpack(x) for x in rows["postings"].to_pylist()]
        p = {name: np.concatenate([x[name] for x in parts]) for name, _ in _COLUMNS}
        found, partner, differ, earlier = near_postings(p)
        if len(found):
            columns = [p["key"][found], p["doc"][found], p["line"][found], p["doc"][partner], p["line"][partner], differ, earlier]
            arrays = [pa.array(c.astype(np.int64), mask=partner < 0 if k in (3, 4) else None) for k, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "doc", "line", "e_doc", "e_line", "differ", "earlier"])


# Whole lines


def _place_keys(docs: np.ndarray, lines: np.ndarray) -> np.ndarray:
    return mix(docs.astype(np.uint64) * _OTHER + lines.astype(np.uint64))


def _fetched(texts: DataFrame, places: DataFrame) -> DataFrame:
    """The lines at the given places (doc, line): doc, line, words.  A bit table leaves out most others where they lie."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _place_keys(*(batch.column(i).to_numpy() for i in (0, 1)))
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["key"])

    wanted = texts.sparkSession.sparkContext.broadcast(bit_table(places.mapInArrow(keys, "key bigint"), places.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1):
                data, offsets = texts_of(part.column(1))
                ends = np.flatnonzero(data == 10)
                start = np.sort(np.concatenate((offsets[:-1], ends + 1), dtype=np.int64))
                stop = np.sort(np.concatenate((offsets[1:], ends), dtype=np.int64))
                # Of several lines that begin at one place (empty texts in a row) each stands by its text in turn.
                size = np.diff(np.searchsorted(ends, offsets)) + 1
                text = np.repeat(np.arange(len(size)), size)
                number = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)
                docs = part.column(0).to_numpy()[text]
                at = np.flatnonzero(hits(wanted.value, _place_keys(docs, number)))
                words = [data[start[i] : stop[i]].tobytes() for i in at]
                yield pa.RecordBatch.from_arrays([pa.array(docs[at], pa.int64()), pa.array(number[at], pa.int64()), pa.array(words, pa.binary())], ["doc", "line", "words"])

    return texts.mapInArrow(run, "doc bigint, line bigint, words binary")


def _alike(a: bytes, b: bytes) -> bool:
    x, y = set(a.lower().split()), set(b.lower().split())
    return 100 * len(x & y) >= PERCENT * len(x | y)


def _verified(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """Places (doc, line) whose line matches that at (e_doc, e_line)."""
    both = pairs.join(words, PLACE).join(words.withColumnsRenamed({"doc": "e_doc", "line": "e_line", "words": "e_words"}), ["e_doc", "e_line"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = list(map(_alike, batch.column(2).to_pylist(), batch.column(3).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], PLACE).filter(pa.array(keep, pa.bool_()))

    return both.select("doc", "line", "words", "e_words").mapInArrow(run, "doc bigint, line bigint")


def _settled(open_lines: DataFrame, near: DataFrame, words: DataFrame) -> DataFrame:
    """Of the open lines, those that match any earlier line: the lines near each other by a word meet in blocks of bounded size."""
    # A word at which an open line only met the partner that didn't match has nothing more to tell.
    tried = open_lines.select(*PLACE, F.col("e_doc").alias("tried_doc"), F.col("e_line").alias("tried_line"))
    keys = near.filter("earlier > 0").join(tried, PLACE).filter("earlier > 1 or e_doc <> tried_doc or e_line <> tried_line").select("key").distinct()
    rows = near.select("key", *PLACE).join(keys, "key", "left_semi").distinct()
    # Words with the same lines tell the same: one of them stands for all (by a 128-bit digest of the lines).
    digests = [F.bit_xor(F.xxhash64(*PLACE, F.lit(i))).alias(f"h{i}") for i in (1, 2)]
    groups_of = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *digests).groupBy("n", "h1", "h2").agg(F.min("key").alias("key"))
    parts = groups_of.select("key", F.ceil(F.col("n") / LINES).cast("int").alias("parts"))
    rows = rows.join(open_lines.select(*PLACE, F.lit(True).alias("open")), PLACE, "left").join(parts, "key")
    rows = rows.withColumn("i", F.pmod(F.xxhash64(*PLACE), F.col("parts")).cast("int"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(words, PLACE)
    side = F.when(F.col("i") == F.col("j"), 0).when(F.col("i") < F.col("j"), 1).otherwise(2)
    blocks = rows.select("key", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"), side.alias("side"), *PLACE, F.coalesce("open", F.lit(False)).alias("open"), "words")
    return blocks.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(_settle, "doc bigint, line bigint")


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the sorted hashes of their line's distinct words, found for whole batches at once."""
    for batch in batches:
        for part in pieces(batch, batch.schema.get_field_index("words")):
            words = split(*texts_of(part.column("words")), lower=True)
            order = np.lexsort((words.hashes, words.text))
            h, owner = words.hashes[order], words.text[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
            at = np.concatenate(([0], np.cumsum(8 * np.bincount(owner[new], minlength=part.num_rows)))).astype(np.int32)
            sets = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(at), pa.py_buffer(h[new].tobytes())])
            yield pa.RecordBatch.from_arrays([*part.columns, sets], [*part.schema.names, "set"])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in groups(_with_sets(batches), ["key", "p", "q"]):
        side, asked = rows["side"].to_numpy(), rows["open"].to_numpy(zero_copy_only=False)
        if not asked.any():
            continue
        docs, lines, whole = rows["doc"].to_numpy(), rows["line"].to_numpy(), rows["words"].to_pylist()
        sets = [np.frombuffer(x, dtype=np.uint64) for x in rows["set"].to_pylist()]
        n = np.array([len(x) for x in sets])
        codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
        first = np.cumsum(n) - n
        age = np.empty(len(n), dtype=np.int64)
        age[np.lexsort((lines, docs))] = np.arange(len(n))
        held = np.zeros(codes.max() + 1, dtype=np.int64)
        found = []
        for i in np.flatnonzero(asked):
            own = codes[first[i] : first[i] + n[i]]
            held[own] = 1
            common = np.add.reduceat(held[codes], first)
            held[own] = 0
            alike = (100 * common >= PERCENT * (n + n[i] - common)) & (age < age[i]) & (side == (3 - side[i] if side[i] else 0))
            if any(_alike(whole[i], whole[j]) for j in np.flatnonzero(alike)):
                found.append(i)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(docs[found], pa.int64()), pa.array(lines[found], pa.int64())], PLACE)


def _bounded(rows: DataFrame, fits: bool) -> DataFrame:
    return F.broadcast(rows) if fits else rows.hint("shuffle_merge")


def removed_classes(scratch: Scratch, named: DataFrame, reps: DataFrame) -> DataFrame:
    """Places of the classes that match an earlier one; reps: doc, line, n, low, high, prefix of each class."""
    spark = named.sparkSession
    n_postings = reps.agg(F.coalesce(F.sum(F.octet_length("prefix")), F.lit(0)).alias("n")).first()["n"] // 5
    n_blocks = 1 << max(0, (n_postings // POSTINGS).bit_length())
    counts = spark.sparkContext.broadcast(bucket_counts(reps.select("prefix"), _key_buckets))
    packed = reps.select("doc", "line", "n", "low", "high", "prefix").mapInArrow(_packed(counts, n_blocks, POSTINGS), "block bigint, postings binary")
    near = scratch.save(packed.repartition("block").sortWithinPartitions("block").mapInArrow(_near, _NEAR), "near")
    best = near.filter("earlier > 0").groupBy(*PLACE).agg(
        F.min(F.struct("differ", "e_doc", "e_line")).alias("best"),
        F.max("earlier").alias("earlier"), F.min(F.struct("e_doc", "e_line")).alias("lo"), F.max(F.struct("e_doc", "e_line")).alias("hi"),
    )
    best = scratch.save(best.select(*PLACE, "best.e_doc", "best.e_line", ((F.col("earlier") > 1) | (F.col("lo") != F.col("hi"))).alias("more")), "best")
    places = scratch.save(near.select(*PLACE).distinct(), "places")
    words = scratch.save(_fetched(named, places), "words")
    matched = scratch.save(_verified(best.select(*PLACE, "e_doc", "e_line"), words), "matched")
    open_lines = scratch.save(best.filter("more").select(*PLACE, "e_doc", "e_line").join(matched, PLACE, "left_anti"), "open")
    if not open_lines.isEmpty():
        matched = matched.unionByName(_settled(open_lines, near, words))
    later = scratch.save(matched.distinct(), "later")
    scratch.drop("near", "best", "places", "words", "matched", "open")
    return later


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each line whose word set has a Jaccard similarity of 0.75 or more with an earlier line's.

    Lines end at LF; words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.
    Earlier means a smaller id, or the same id and further up; the earlier line
    may itself be removed.  Returns a row per document: ``id_col``, n_lines,
    n_removed, kept_text (kept lines joined by LF).

    * null text: no lines, null kept_text; empty text: one line, without words;
      a line without words: always kept, matches nothing;
    * very long texts: all their lines are compared, however long;
    * rows that repeat an id and its text are one document, and each row is
      returned; different texts under one id are documents of their own, in the
      order of their texts; a null id: the row is returned unchanged and its
      lines match nothing;
    * empty table: empty result; other columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "lines")
    documents, texts = keyed(scratch, docs, id_col, text_col)
    named = texts.filter("id is not null and body is not null").select("doc", "body")
    counts = bucket_counts(named.select("body"), _word_buckets)
    ranks = np.empty(len(counts), dtype=np.uint32)
    ranks[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    sets = named.mapInArrow(_sets(spark.sparkContext.broadcast(ranks)), _SET)
    reps = sets.groupBy("d1", "d2", "n").agg(F.min(F.struct("doc", "line")).alias("lead"), F.first("low").alias("low"), F.first("high").alias("high"), F.first("prefix").alias("prefix"))
    reps = scratch.save(reps.select("lead.doc", "lead.line", "n", "low", "high", "prefix"), "reps")
    later = removed_classes(scratch, named, reps)
    leads = reps.select(*PLACE).join(_bounded(later, later.count() <= BROADCAST_ROWS), PLACE, "left_anti")
    kept = scratch.save(leads.groupBy("doc").agg(F.collect_list(F.col("line").cast("int")).alias("lines")), "kept")
    scratch.drop("reps", "later")
    size = kept.agg(F.coalesce(F.sum(F.size("lines") * 4 + 32), F.lit(0)).alias("bytes")).first()["bytes"]
    # Few and short lists go to the texts; otherwise the texts go to the lists.
    rows = documents.join(_bounded(kept, size <= BROADCAST_BYTES), "doc", "left")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, bodies = [], [], []
            for name, text, stay in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                lines = text.split("\n") if text is not None else []
                stays = set(stay or ())
                left = lines if name is None else [x for i, x in enumerate(lines) if i in stays or not x.encode("utf-8", "surrogatepass").split()]
                total.append(len(lines))
                removed.append(len(lines) - len(left))
                bodies.append("\n".join(left) if text is not None else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(bodies, pa.string())], ["id", "n_lines", "n_removed", "kept_text"])

    found = rows.select("id", "body", "lines").mapInArrow(run, f"id {kind}, n_lines bigint, n_removed bigint, kept_text string")
    return found.withColumnRenamed("id", id_col)
