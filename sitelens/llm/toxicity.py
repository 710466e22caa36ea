"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on toxic
text.  A text is read in windows of whole words; each is compressed with the
ordinary dictionary alone and with the toxic one behind it, and the bytes that
the toxic dictionary saves are the window's gain.  A logistic curve, fitted on
documents that the dictionaries have not seen, turns a document's largest gains
and the number of its windows into a score.

Labels are of documents, and most of a toxic document is ordinary text.  So the
toxic dictionary is trained on the words of toxic documents that stand in many
more different contexts there than in ordinary ones; contexts rather than
occurrences, as copies of a document repeat its words but not their neighbours.

What is fitted is bounded: the numbers below.  Learning runs in tasks; the
driver gets counted words, windows and features, never a text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.durable import Scratch, small_batches

#: Labelled documents to learn from, of each class: toxic ones, ordinary ones to calibrate on, and ordinary ones for their dictionary.
TOXIC_DOCS, PLAIN_DOCS, BASE_DOCS = 2_500, 5_000, 2_500
#: Windows that the ordinary dictionary is trained on, and strings of words for the toxic one.
WINDOWS, STRINGS = 60_000, 10_000
#: Bytes of the dictionaries, and of a window.
ORDINARY_BYTES, TOXIC_BYTES, WINDOW = 65_536, 4_096, 64
#: A word teaches if it has so many contexts (and this share of the number of toxic documents), and its rate exceeds the ordinary one so many times.
LEAST_CONTEXTS, CONTEXT_SHARE, CONTRAST, LEAST_LETTERS = 3, 0.01, 20, 4
MOST_WORDS = 4_096
#: Bytes behind each window: zstandard starts no match within the last eight.
_PAD = b" \n\n\n\n\n\n\n\n"
_GAPS = re.compile(r"[\W\d_]+")
_CUT = re.compile(rb"(?s).{1,%d}(?= )|.{%d}" % (WINDOW, WINDOW))
_PARAMETERS = zstandard.ZstdCompressionParameters(
    strategy=zstandard.STRATEGY_GREEDY, min_match=6, window_log=17, chain_log=17, hash_log=17, search_log=4, target_length=64,
    write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
)
TOP = 3
N_FEATURES = TOP + 2


def held_out(doc_id: Column) -> Column:
    """Documents whose labels teach nothing."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def words(text: str) -> str:
    """The words of a text in small letters, each between two spaces."""
    return " " + _GAPS.sub(" ", text.lower()).strip(" ") + " "


def windows(text: str) -> Iterator[bytes]:
    """Windows of whole words; only words longer than a window are cut."""
    held = words(text).encode("utf-8", "replace")
    return (m.group() + _PAD for m in _CUT.finditer(held)) if len(held) > 2 else iter(())


def _trained(size: int, samples: list[bytes], **parameters: int) -> bytes:
    """Content of a dictionary; what is too little to train on is taken as it is."""
    try:
        return zstandard.train_dictionary(size, samples, **parameters).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    if not content:
        return zstandard.ZstdCompressor(compression_params=_PARAMETERS)
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=_PARAMETERS)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=_PARAMETERS)


class Gauge:
    """Features of texts: the largest gains, all of them by the root of the number of windows, and that number."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = _compressor(ordinary).compress, _compressor(ordinary + toxic).compress

    def features(self, text: str) -> list[float]:
        top, total, n = [0] * TOP, 0, 0
        for window in windows(text):
            gain = len(self.ordinary(window)) - len(self.toxic(window))
            n += 1
            if gain > 0:
                total += gain
                if gain > top[-1]:
                    top = sorted([*top, gain], reverse=True)[:TOP]
        return [*map(float, top), total / math.sqrt(max(n, 1)), math.log(max(n, 1))]


@dataclass
class Model:
    """Dictionaries and the logistic curve over standardised features; without both classes the share of toxic rows alone."""

    share: float
    ordinary: bytes = b""
    toxic: bytes = b""
    mean: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES))
    scale: np.ndarray = field(default_factory=lambda: np.ones(N_FEATURES))
    weights: np.ndarray | None = None

    def scores(self, features: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(features), self.share)
        return 1 / (1 + np.exp(-np.clip(self._design(features) @ self.weights, -30, 30)))

    def _design(self, features: np.ndarray) -> np.ndarray:
        x = (features - self.mean) / self.scale
        return np.column_stack([x, x[:, :-1] * x[:, -1:], np.ones(len(x))])

    def calibrated(self, features: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> Model:
        """The curve by Newton's method, with a small ridge; rows count by their weights."""
        out = replace(self, mean=features.mean(axis=0), scale=features.std(axis=0) + 1e-9)
        x, ridge = out._design(features), 1e-4 * weight.sum()
        w = np.zeros(x.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
            w -= np.linalg.solve(curve, x.T @ (weight * (p - toxic)) + ridge * w)
        return replace(out, weights=w)


def _map(rows: DataFrame, each, schema: str) -> DataFrame:
    """Rows of whole batches: ``each`` takes lists of the columns and gives tuples."""
    arrow = rows.sparkSession.createDataFrame([], schema).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*each(*[c.to_pylist() for c in batch.columns]), strict=True))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(found, arrow, strict=True)], schema=arrow)

    return rows.mapInArrow(run, schema)


def _contexts(toxic: list[int], half: list[int], text: list[str]) -> Iterator[tuple]:
    for t, h, body in zip(toxic, half, text, strict=True):
        found = words(body).split()
        for at in set(zip(found, ["", *found], [*found[1:], ""], strict=False)):
            if len(at[0]) >= LEAST_LETTERS:
                yield (*at, t, h)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn from labelled documents that are not held out.

    Of each class the documents with the least hashes of their ids are taken,
    up to the numbers above.  Toxic ones are halved: each half is scored with
    the dictionary of the other to calibrate, then both make the final one.
    Of an id with several texts the one with the least hash teaches; of an id
    with several labels the toxic one counts; null ids, labels and texts teach
    nothing.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "toxicity")
    name = F.col(id_col).cast("string")
    known = labels.filter(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).withColumn("order", F.xxhash64(F.col("id").cast("string")))
    # Ordinary documents teach either the dictionary (base) or the curve.
    base = F.crc32(F.col("id").cast("string")) % 5 == 4
    groups = [(F.col("toxic") == 1, TOXIC_DOCS), ((F.col("toxic") == 0) & ~base, PLAIN_DOCS), ((F.col("toxic") == 0) & base, BASE_DOCS)]
    sizes = known.agg(*[F.count(F.when(g, 1)).alias(f"n{i}") for i, (g, _) in enumerate(groups)]).first()
    chosen = [known.filter(g).orderBy("order", "id").limit(n).withColumn("group", F.lit(i)) for i, (g, n) in enumerate(groups)]
    chosen = chosen[0].unionByName(chosen[1]).unionByName(chosen[2])
    taught = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    taught = taught.groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("toxic").alias("toxic"), F.first("group").alias("group"))
    taught = scratch.save(taught.withColumn("half", F.pmod(F.xxhash64(F.lit("half"), F.col("id").cast("string")), F.lit(2)).cast("int")), "taught")

    held = {r["group"]: r["n"] for r in taught.groupBy("group").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_plain = held.get(0, 0), held.get(1, 0) + held.get(2, 0)
    share = sizes["n0"] / max(1, sum(sizes))
    if not n_toxic or not n_plain:
        return Model(share)

    contexts = _map(taught.select("toxic", "half", "text"), _contexts, "word string, before string, after string, toxic int, half int").distinct()
    is_toxic = F.col("toxic") == 1
    counts = [F.count(F.when(is_toxic & (F.col("half") == h), 1)).alias(f"t{h}") for h in (0, 1)]
    counted = contexts.groupBy("word").agg(*counts, F.count(F.when(~is_toxic, 1)).alias("plain"))
    n_half = {r["half"]: r["n"] for r in taught.filter(is_toxic).groupBy("half").agg(F.count(F.lit(1)).alias("n")).collect()}

    def teaches(count: Column, n: int) -> Column:
        rate, usual = (count + 0.5) / (n + 1), (F.col("plain") + 0.5) / (n_plain + 1)
        return (count >= max(LEAST_CONTEXTS, CONTEXT_SHARE * n)) & (rate > CONTRAST * usual)

    every = F.col("t0") + F.col("t1")
    marks = [teaches(F.col("t0"), n_half.get(0, 0)), teaches(F.col("t1"), n_half.get(1, 0)), teaches(every, n_toxic)]
    rows = counted.select("word", every.alias("n"), *[m.alias(f"m{i}") for i, m in enumerate(marks)]).filter("m0 or m1 or m2").orderBy(F.desc("n"), "word").limit(MOST_WORDS).collect()
    vocabularies = [frozenset(r["word"] for r in rows if r[f"m{i}"]) for i in range(3)]

    def strings(toxic: list[int], half: list[int], text: list[str]) -> Iterator[tuple]:
        for h, body in zip(half, text, strict=True):
            for i, vocabulary in enumerate(vocabularies):
                found = [w for w in words(body).split() if w in vocabulary] if i in (h, 2) else []
                for at in range(0, len(found), 32):
                    yield i, " " + " ".join(found[at : at + 32]) + " "

    texts = _map(taught.filter(is_toxic).select("toxic", "half", "text"), strings, "i int, body string").orderBy(F.xxhash64("body"), "i").limit(STRINGS).collect()
    cut = _map(taught.filter("group = 2").select("text"), lambda text: ((w,) for t in text for w in windows(t)), "body binary")
    base_windows = cut.orderBy(F.xxhash64("body")).limit(WINDOWS).collect()
    ordinary = _trained(ORDINARY_BYTES, [bytes(r["body"]) for r in base_windows])
    toxic = [_trained(TOXIC_BYTES, own, k=32, d=6) for own in ([r["body"].encode() for r in texts if r["i"] == i] for i in range(3))]

    def measured(kind: list[int], half: list[int], text: list[str]) -> Iterator[tuple]:
        gauges: dict[int, Gauge] = {}
        for k, h, body in zip(kind, half, text, strict=True):
            other = 1 - h
            if other not in gauges:
                gauges[other] = Gauge(ordinary, toxic[other])
            yield k, gauges[other].features(body)

    found = _map(taught.filter("group < 2").select("toxic", "half", "text"), measured, "toxic int, features array<double>").collect()
    x, y = np.array([r["features"] for r in found]), np.array([r["toxic"] for r in found], dtype=float)
    # Classes count as they do among all labelled rows.
    weight = np.where(y == 1, sizes["n0"] / n_toxic, (sizes["n1"] + sizes["n2"]) / max(1, held.get(1, 0)))
    if len(set(y)) < 2:
        return Model(share)
    return Model(share, ordinary, toxic[2]).calibrated(x, y, weight)


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (``id_col``, held_out, score, predicted) of documents, every window of every text read."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # under 100 kB
    source = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        gauge = Gauge(own.ordinary, own.toxic)
        for batch in batches:
            features = np.array([gauge.features(t or "") for t in batch.column(2).to_pylist()]).reshape(-1, N_FEATURES)
            scores = own.scores(features)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    return source.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score documents with a model learnt from ``labels`` (``id_col``, toxic).

    * null and empty texts: the score of a text without windows;
    * very long texts: all windows; words longer than a window are cut at its end;
    * null ids: scored, never held out, teach nothing; repeated rows: each scored;
    * no labels, or labels of one class only: the share of toxic labels (0 without labels);
    * empty table: empty result; other columns, whatever their names, are ignored.
    """
    return score_texts(docs, fit(docs, labels, id_col, text_col), id_col, text_col)
