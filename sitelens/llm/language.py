"""Language identification by word-first backoff.

Training counts words, and character n-grams of words, per language over all
labelled rows.  A known word adds its log frequency in each language; an unseen
word falls back to its character n-grams, from the longest length down: of each
length only the known n-grams count, and shorter ones are asked only where no
n-gram of the longer length is known.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.durable import Scratch, small_batches
from .frequent import most_frequent

UNKNOWN = "und"
#: The model keeps this many words and this many n-grams of each length, shared evenly among the languages, each
#: of which takes its own most frequent ones; other words back off.  All counts cover all labelled rows.
#: The bound keeps what is sent to each executor to about 80 bytes and 8 bytes a language for each key.
MAX_WORDS, MAX_GRAMS = 100_000, 20_000
#: Languages a model may have; each is a column of counts.
MAX_LANGUAGES = 1_000
#: Lengths of the n-grams an unseen word falls back to.
GRAM_LENGTHS = (4, 3, 2, 1)
#: Added to every count, so that a word of one language is possible in the others.
SMOOTHING = 0.5
#: Weight of an n-gram against a word.
GRAM_WEIGHT = 0.5
#: Unseen words a task remembers.
REMEMBERED = 150_000
_WORD = re.compile(r"[^\W\d_]+")


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")


def _grams(padded: Column, size: int) -> Column:
    """All runs of ``size`` characters."""
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(padded) + 1 - size, F.lit(1))), lambda i: i <= F.length(padded) + 1 - size)
    return F.transform(places, lambda i: F.substring(padded, i, F.lit(size)))


@dataclass
class Model:
    """Rows of ``table`` hold log frequencies by language; the last row is all zeros."""

    langs: list[str]
    words: dict[str, int]
    grams: list[tuple[int, dict[str, int]]]  # by length, longest first
    table: np.ndarray

    def predict(self, text: str | None, unseen: Unseen) -> tuple[str, float]:
        counts = Counter(_WORD.findall(text.lower())) if text else {}
        if not counts or not self.langs:
            return UNKNOWN, 0.0
        words = list(counts)
        rows = list(map(self.words.get, words))
        new = [w for w, r in zip(words, rows, strict=True) if r is None]
        found = unseen.rows(self, new)
        known = [r for r in rows if r is not None]
        n = np.fromiter(counts.values(), dtype=np.float64, count=len(words))
        is_new = np.fromiter((r is None for r in rows), dtype=bool, count=len(rows))
        spoken = n.copy()
        spoken[np.flatnonzero(is_new)[found < 0]] = 0
        total = n[~is_new] @ self.table[known] if known else np.zeros(len(self.langs))
        if len(new):
            total = total + spoken[is_new] @ unseen.table[found]
        words_counted = spoken.sum()
        if not words_counted:
            return UNKNOWN, 0.0
        # The mean evidence of a word, times at most ten words: long texts aren't surer than the model is.
        share = np.exp((total - total.max()) * min(1.0, 10.0 / words_counted))
        best = int(np.argmax(total))  # the languages are sorted: ties go to the first
        return self.langs[best], float(share[best] / share.sum())

    def gram_rows(self, word: str) -> list[int]:
        """Rows of the longest n-grams of a word that are known; the zero row where none is."""
        padded = f"<{word}>"
        for size, grams in self.grams:
            known = [r for i in range(len(padded) - size + 1) if (r := grams.get(padded[i : i + size])) is not None]
            if known:
                return known
        return [len(self.table) - 1]


class Unseen:
    """Evidence of words the model doesn't know, remembered by a task; -1 stands for no letter."""

    def __init__(self, langs: int):
        self.known: dict[str, int] = {}
        self.table, self.used = np.zeros((1024, max(langs, 1))), 0

    def rows(self, model: Model, words: list[str]) -> np.ndarray:
        if self.used + len(words) > REMEMBERED:
            self.known.clear()
            self.used = 0
        new = [w for w in words if w not in self.known]
        spoken = [w for w in new if w.isalpha() or any(map(str.isalpha, w))]
        if len(spoken) < len(new):
            self.known |= dict.fromkeys(set(new) - set(spoken), -1)
        if spoken:
            grams = [model.gram_rows(w) for w in spoken]
            sizes = np.fromiter(map(len, grams), dtype=np.int64, count=len(grams))
            flat = np.fromiter(itertools.chain.from_iterable(grams), dtype=np.int64, count=int(sizes.sum()))
            sums = np.add.reduceat(model.table[flat], np.cumsum(sizes) - sizes, axis=0)
            while self.used + len(spoken) > len(self.table):
                self.table = np.concatenate((self.table, np.zeros_like(self.table)))
            self.table[self.used : self.used + len(spoken)] = GRAM_WEIGHT * sums / sizes[:, None]
            self.known |= dict(zip(spoken, range(self.used, self.used + len(spoken)), strict=True))
            self.used += len(spoken)
        return np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> Model:
    """Learn from every row of ``docs`` whose language is not null; null texts teach nothing.

    Words are runs of letters, lower-cased; n-grams are those of ``<word>``, a
    word of any length.  The value of a key in a language is the log of its
    count plus ``SMOOTHING`` over the sum of all counts of kept keys of its kind.
    """
    scratch = Scratch(docs.sparkSession, "language")
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("body"))
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: {lang_col} does not look like a language column")
    if not langs:
        return Model([], {}, [], np.zeros((1, 0)))
    by_lang = [f"n{i}" for i in range(len(langs))]
    spoken = rows.select("lang", F.explode(_words(F.col("body"))).alias("key"))
    words = scratch.save(
        spoken.groupBy("key").agg(*[F.count_if(F.col("lang") == lang).alias(c) for c, lang in zip(by_lang, langs, strict=True)]), "words"
    )
    tables: list[np.ndarray] = []

    def frequent(counts: DataFrame, limit: int) -> dict[str, int]:
        """The most frequent keys, numbered; their log frequencies join the tables."""
        top = most_frequent(counts, limit // max(1, len(langs)), by_lang).select("key", *by_lang).toPandas()
        n = top[by_lang].to_numpy(dtype=np.float64).reshape(len(top), len(langs))
        at = sum(map(len, tables))
        tables.append(np.log((n + SMOOTHING) / (n.sum(axis=0) + SMOOTHING * len(n))))
        return dict(zip(top["key"], range(at, at + len(top)), strict=True))

    known = frequent(words, max_words)
    padded = F.concat(F.lit("<"), F.col("key"), F.lit(">"))
    by_size = []
    for size in GRAM_LENGTHS:
        counts = words.select(*by_lang, F.explode(_grams(padded, size)).alias("key")).groupBy("key").agg(*[F.sum(c).alias(c) for c in by_lang])
        by_size.append((size, frequent(scratch.save(counts, f"grams-{size}"), max_grams)))
    return Model(langs, known, by_size, np.vstack([*tables, np.zeros((1, len(langs)))]))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Language of every whole text: ``id_col``, the columns named in ``keep``, lang_pred, score (0 to 1).

    Only the text counts.  Ties go to the language that sorts first.

    * null text, or one without a letter, or a model without languages: ``und`` and score 0;
    * null ids and repeated rows: judged one by one;
    * empty table: empty result; other columns, whatever their names, are ignored.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by max_words and max_grams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = sent.value, Unseen(len(sent.value.langs))
        for batch in batches:
            found = [known.predict(t, seen) for t in batch.column(1).to_pylist()]
            langs, scores = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema.names)

    rows = docs.select(F.col(id_col), F.col(text_col).alias("_body"), *keep)
    schema = T.StructType([rows.schema[c] for c in (id_col, *keep)]).add("lang_pred", T.StringType()).add("score", T.DoubleType())
    return rows.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Rows never learnt from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fit on the labelled rows that aren't held out, then predict every row.

    Returns a row per input row: ``id_col``, held_out, lang_pred, score.

    * null text, or one without a letter, or no labelled row: ``und`` and score 0;
    * null label: the row teaches nothing; null id: not held out;
    * very long texts and words count whole; null ids and repeated rows are judged
      one by one; ties go to the language that sorts first;
    * empty table: empty result; other columns, whatever their names, are ignored.
    """
    model = fit(docs.filter(~held_out(F.col(id_col))), text_col, lang_col)
    found = identify(docs, model, id_col, text_col)
    return found.select(id_col, held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score")
