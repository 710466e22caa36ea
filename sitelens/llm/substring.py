"""Removal of repeated passages by super-k-mer partitioning.

A window is 35 consecutive words.  Its minimiser is the 8-word gram of smallest
hash inside it; consecutive windows whose minimiser is the same gram at the same
place travel together, as one packed string of their words (a super-k-mer), to
the bucket of that gram.  Equal windows have equal minimisers and so meet in one
bucket, where sorting counts them exactly.

A first pass counts the minimisers themselves.  A minimiser that occurs once in
the corpus holds no repeated window, so its super-k-mer stays where it is.  The
bucket of one that occurs very often is split: equal super-k-mers are counted
before the shuffle and go on once, the different ones are cut again by a second
minimiser, and the windows are counted by sorting as before.  Both sets are handed
to the tasks as bit tables of bounded size: a false hit only sends a super-k-mer
that could have stayed, or splits a bucket that could have been whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import Scratch, small_batches
from .bits import bit_table, hits
from .documents import keyed
from .words import Words, mix, pieces, split, texts_of

WINDOW, GRAM = 35, 8
#: Buckets of minimisers with more super-k-mers than this are split; it bounds what a task holds of one bucket (about
#: 100 MB).  Splitting costs a row for each super-k-mer of the bucket in a join, so smaller buckets stay whole.
HOT = 50_000
#: Super-k-mers a bucket task sorts at a time.
CHUNK = 8_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64((1 << 28) - 1)


def _rolled(h: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hashes of all runs of ``size`` values, by doubling."""
    runs, have = None, 0
    power, power_size, factor = h, 1, int(_FACTOR)
    todo = size
    while todo:
        if todo & 1:
            if runs is None:
                runs, have = power, power_size
            else:
                n = len(h) - have - power_size + 1
                runs = runs[:n] * np.uint64(factor) + power[have : have + n]
                have += power_size
        todo >>= 1
        if todo:
            n = len(h) - 2 * power_size + 1
            power = power[:n] * np.uint64(factor) + power[power_size : power_size + n]
            factor = factor * factor % (1 << 64)
            power_size *= 2
    return runs


def _least(grams: np.ndarray) -> np.ndarray:
    """Of each window, the place of its smallest gram; the leftmost of equals."""
    least = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    span, want = 1, WINDOW - GRAM + 1
    while span < want:
        step = min(span, want - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    return (least & _PLACE).astype(np.int64)


def _runs(place: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of consecutive windows that share a minimiser: first windows, and windows behind the last ones."""
    before = np.concatenate(([False], valid[:-1]))
    start = np.flatnonzero(valid & (~before | (np.diff(place, prepend=-1) != 0)))
    last = np.concatenate((valid[1:] & (place[1:] == place[:-1]), [False]))
    return start, np.flatnonzero(valid & ~last) + 1


def cut(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Super-k-mers of all texts: minimisers, first windows, windows behind the last ones; and all grams."""
    h = words.hashes
    if len(h) < WINDOW:
        none = np.array([], dtype=np.int64)
        return none.astype(np.uint64), none, none, h[:0]
    grams = mix(_rolled(h, GRAM))
    place = _least(grams)
    start, stop = _runs(place, words.text[: len(place)] == words.text[WINDOW - 1 :])
    return grams[place[start]], start, stop, grams


def _words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _minimisers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [cut(split(*texts_of(part.column(0)), lower=False))[0] for part in pieces(batch, 0)]
        keys, n = np.unique(np.concatenate(found) if found else np.array([], dtype=np.uint64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])


_SENT = pa.schema([("bucket", pa.int64()), ("hot", pa.bool_()), ("doc", pa.int64()), ("start", pa.int64()), ("packed", pa.binary())])


def _sender(tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, hot = tables.value
        for batch in batches:
            for part in pieces(batch, 1):
                data, offsets = texts_of(part.column(1))
                words = split(data, offsets, lower=False)
                keys, start, stop, _ = cut(words)
                sent = hits(repeated, keys)
                keys, start, stop = keys[sent], start[sent], stop[sent]
                often = hits(hot, keys)
                text = words.text[start]
                docs = part.column(0).to_numpy()[text]
                begin, end = words.start[start].tolist(), words.stop[stop + WINDOW - 2].tolist()
                packed = [b" ".join(data[a:b].tobytes().split()) for a, b in zip(begin, end, strict=True)]
                columns = [keys.view(np.int64), often, docs, start - words.first[text], packed]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SENT, strict=True)], schema=_SENT)

    return run


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings (bucket, string, packed) cut into runs of windows that share a minimiser in a second order of grams, too."""
    for batch in batches:
        buckets, strings, starts, packed = [], [], [], []
        for bucket, string, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            data = np.frombuffer(whole, dtype=np.uint8)
            words = split(data, np.array([0, len(data)]), lower=False)
            own = mix(mix(_rolled(words.hashes, GRAM)) + _FACTOR)
            place = _least(own)
            start, stop = _runs(place, np.ones(len(place), dtype=bool))
            keys = mix(np.full(len(start), bucket, dtype=np.int64).view(np.uint64) + own[place[start]] * _FACTOR)
            buckets.append(keys.view(np.int64))
            strings += [string] * len(start)
            starts += start.tolist()
            packed += [whole[a:b] for a, b in zip(words.start[start].tolist(), words.stop[stop + WINDOW - 2].tolist(), strict=True)]
        columns = [np.concatenate(buckets) if buckets else np.zeros(0, dtype=np.int64), np.array(strings, dtype=np.int64), np.array(starts, dtype=np.int64)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(packed, pa.binary())], ["bucket", "doc", "start", "packed"])


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        return found


def repeated_windows(buckets: list[int], packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(super-k-mer, window in it) of each window that occurs more than once among whole buckets."""
    number = _Numbers()
    parts = [np.fromiter(map(number.__getitem__, p.split(b" ")), dtype=np.int64) for p in packed]
    sizes = np.array([len(p) for p in parts])
    words = np.concatenate(parts)
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    windows = sizes - WINDOW + 1
    owner = np.repeat(np.arange(len(parts)), windows)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = first[owner] + inside
    h = _rolled(mix(words.astype(np.uint64) + np.uint64(1)), WINDOW)[at]
    order = np.argsort(h, kind="stable")
    h, at = h[order], at[order]
    same = np.flatnonzero(h[1:] == h[:-1])
    if not len(same):
        return owner[:0], inside[:0]
    # Equal hashes are confirmed word by word.
    equal = np.ones(len(same), dtype=bool)
    for k in range(WINDOW):
        equal &= words[at[same] + k] == words[at[same + 1] + k]
    twice = np.zeros(len(h), dtype=bool)
    twice[same[equal]] = twice[same[equal] + 1] = True
    for lone in np.unique(h[same[~equal]]):  # different windows under one hash: compare them whole
        group = np.flatnonzero(h == lone)
        keys = [words[a : a + WINDOW].tobytes() for a in at[group]]
        twice[group] = [keys.count(k) > 1 for k in keys]
    return owner[order[twice]], inside[order[twice]]


def _spans(docs: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
    """Runs of consecutive windows of a document as word spans."""
    order = np.lexsort((starts, docs))
    docs, starts = docs[order], starts[order]
    new = np.concatenate(([True], (docs[1:] != docs[:-1]) | (starts[1:] > starts[:-1] + 1))) if len(docs) else np.array([], dtype=bool)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(docs))[: len(begin)] - 1
    return pa.RecordBatch.from_arrays([pa.array(docs[begin]), pa.array(starts[begin]), pa.array(starts[end] + WINDOW)], ["doc", "start", "stop"])


def _count_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket; whole buckets are counted some thousand super-k-mers at a time."""
    buckets: list[int] = []
    docs: list[int] = []
    starts: list[int] = []
    packed: list[bytes] = []

    def counted(n: int) -> pa.RecordBatch | None:
        # A bucket of one super-k-mer repeats nothing: all its windows lie differently around one gram.
        b = np.array(buckets[:n])
        alone = np.concatenate(([True], b[1:] != b[:-1])) & np.concatenate((b[1:] != b[:-1], [True]))
        rows = np.flatnonzero(~alone)
        if not len(rows):
            return None
        owner, inside = repeated_windows([buckets[i] for i in rows], [packed[i] for i in rows])
        return _spans(np.array([docs[i] for i in rows])[owner], np.array([starts[i] for i in rows])[owner] + inside) if len(owner) else None

    for batch in batches:
        for have, column in zip((buckets, docs, starts, packed), (0, 1, 2, 3), strict=True):
            have.extend(batch.column(column).to_pylist())
        if len(buckets) >= CHUNK:
            n = len(buckets)
            while n and buckets[n - 1] == buckets[-1]:  # the last bucket may go on
                n -= 1
            if n:
                if found := counted(n):
                    yield found
                for have in (buckets, docs, starts, packed):
                    del have[:n]
    if buckets and (found := counted(len(buckets))):
        yield found


def _hot_spans(scratch: Scratch, sent: DataFrame) -> DataFrame:
    """Spans (doc, start, stop) of repeated windows in split buckets.

    All windows of a super-k-mer that occurs more than once are repeated; the
    different ones go to the split buckets once each, and what is found there
    holds for all rows that have the string.
    """
    strings = sent.groupBy("packed").agg(F.min(F.struct("doc", "start")).alias("lead"), F.count(F.lit(1)).alias("n"), F.min("bucket").alias("bucket"))
    strings = scratch.save(strings.withColumn("string", F.monotonically_increasing_id()), "strings")
    buckets = strings.select("bucket", "string", "packed").mapInArrow(_split, "bucket bigint, doc bigint, start bigint, packed binary").repartition("bucket").sortWithinPartitions("bucket")
    inside = buckets.mapInArrow(_count_buckets, "doc bigint, start bigint, stop bigint").select(F.col("doc").alias("string"), F.col("start").alias("a"), F.col("stop").alias("b"))
    copies = strings.filter("n > 1").select("string", F.lit(0).cast("bigint").alias("a"), F.size(F.split(F.col("packed").cast("string"), " ")).cast("bigint").alias("b"))
    found = scratch.save(inside.join(copies.select("string"), "string", "left_anti").unionByName(copies), "inside")
    alone = strings.filter("n = 1").join(found, "string").select("lead.doc", "lead.start", "a", "b")
    more = sent.join(strings.filter("n > 1").join(found, "string").select("packed", "a", "b"), "packed").select("doc", "start", "a", "b")
    return alone.unionByName(more).select("doc", (F.col("start") + F.col("a")).alias("start"), (F.col("start") + F.col("b")).alias("stop"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each word covered by a 35-word window that also starts anywhere else.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; windows lie in one document
    and are judged on the input.  Returns a row per document: ``id_col``,
    n_words, n_removed, kept_text (the kept words joined by one space).

    * null text, or fewer than 35 words: nothing is removed;
    * very long texts: all their windows count;
    * rows that repeat an id (or a null id) and its text are one document;
      different texts under one id are documents of their own;
    * empty table: empty result; other columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "substring")
    rows, texts = keyed(scratch, docs, id_col, text_col)
    texts = texts.select("doc", "body")
    counts = texts.select("body").mapInArrow(_minimisers, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    repeated = scratch.save(counts.filter("n > 1"), "repeated")
    hot = repeated.filter(F.col("n") > HOT)
    n_hot = hot.count()
    tables = spark.sparkContext.broadcast((bit_table(repeated, repeated.count()), bit_table(hot, n_hot)))
    sent = scratch.save(texts.mapInArrow(_sender(tables), "bucket bigint, hot boolean, doc bigint, start bigint, packed binary"), "sent")
    buckets = sent.filter("not hot").select("bucket", "doc", "start", "packed").repartition("bucket").sortWithinPartitions("bucket")
    spans = buckets.mapInArrow(_count_buckets, "doc bigint, start bigint, stop bigint")
    if n_hot:
        spans = spans.unionByName(_hot_spans(scratch, sent.filter("hot").select("bucket", "doc", "start", "packed")))
    by_doc = spans.groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    rows = rows.join(by_doc, "doc", "left")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept = [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = _words(text)
                left = words
                if spans:
                    gone = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(gone, [s["start"] for s in spans], 1)
                    np.add.at(gone, [s["stop"] for s in spans], -1)
                    left = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]
                total.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept_text"]
            )

    found = rows.select("id", "body", "spans").mapInArrow(run, f"id {kind}, n_words bigint, n_removed bigint, kept_text string")
    return found.withColumnRenamed("id", id_col)
