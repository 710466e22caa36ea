"""Column functions over text: blanks, normalisation, shingles, readability, key terms."""

from __future__ import annotations

import heapq
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from decimal import Decimal
from itertools import pairwise

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.durable import small_batches

# Words too common to be key terms.
STOP_WORDS = [
    "در", "به", "از", "که", "این", "را", "با", "است", "برای", "آن", "یک", "شود", "شده",
    "خود", "ها", "می", "یا", "هم", "نیز", "تا", "بر", "اما", "وی", "شد", "کرد", "کند",
    "کرده", "بود", "گفت", "پس", "باید", "چون", "دیگر", "اگر", "همه", "ما", "من", "او",
    "the", "and", "a", "an", "in", "to", "of", "for", "is", "on", "that", "by", "this",
    "with", "i", "you", "it", "not", "or", "be", "are", "from", "at", "as", "your",
    "all", "have", "new", "more", "was", "we", "will", "my", "has", "but", "our", "their",
]

# Link texts that say nothing about their target.
GENERIC_ANCHORS = [
    "click here", "here", "read more", "learn more", "more", "link", "page", "website",
    "details", "info", "view", "continue", "this link", "source", "article",
    "اینجا کلیک کنید", "کلیک کنید", "اینجا", "ادامه مطلب", "بیشتر بخوانید",
    "مشاهده بیشتر", "اطلاعات بیشتر", "مشاهده", "لینک", "صفحه", "منبع",
    "انقر هنا", "اضغط هنا", "اقرأ المزيد", "المزيد", "هنا",
]

# What counts as a word, and where sentences end.
#: Words joined by a zero-width non-joiner or a hyphen count as one.
WORD = r"[\p{L}\p{N}]+(?:[\x{200C}-][\p{L}\p{N}]+)*"


def blank(text: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(~text.rlike(r"(?U)\S"), F.lit(True))


def utrim(text: Column) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Compatibility form; only text outside ASCII leaves the JVM."""
    return F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def _letters(text: Column) -> Column:
    return F.translate(text, "يىك", "ییک")


def normalize_phrase(phrase: Column) -> Column:
    """Search phrase in its comparable form."""
    return F.lower(_letters(nfkc(utrim(phrase))))


def normalize_text(text: Column) -> Column:
    """Text in its comparable form: marks off, punctuation as space, spaces collapsed."""
    out = _letters(F.lower(nfkc(text)))
    out = F.regexp_replace(out, " ?‌ ?", "‌")
    out = F.regexp_replace(out, r"[\p{Mn}\x{0640}]", "")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}\x{200C}]+", " ")
    return F.trim(out)


def content_hash(normalized: Column) -> Column:
    return F.upper(F.sha2(normalized, 256))


def shingles(normalized: Column) -> Column:
    """Distinct word triples; the distinct words of a text with fewer than three."""
    words = F.filter(F.split(normalized, " "), lambda w: w != "")

    def of(own: Column) -> Column:
        triples = F.transform(F.sequence(F.lit(1), F.greatest(F.size(own) - 2, F.lit(1))), lambda i: F.array_join(F.slice(own, i, 3), " "))
        return F.when(F.size(own) < 3, own).otherwise(triples)

    return F.array_distinct(once(words, of))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two shingle sets, half-even to 4 places; 0 where one is empty, 1 where both are."""
    both = F.size(F.array_intersect(a, b))
    share = both.cast("decimal(18,10)") / (F.size(a) + F.size(b) - both)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0)).otherwise(F.bround(share, 4)).cast("decimal(6,4)")


def _triples(normalized: str) -> set:
    words = [w for w in normalized.split(" ") if w]
    return set(zip(words, words[1:], words[2:], strict=False)) if len(words) >= 3 else set(words)


def _share(a: str | None, b: str | None) -> Decimal | None:
    """``jaccard`` of the shingles of two normalised texts, which may be null."""
    if a is None or b is None:
        rest = a if b is None else b
        return Decimal(0) if rest is not None and not rest.strip(" ") else None
    x, y = _triples(a), _triples(b)
    both = len(x & y)
    union = len(x) + len(y) - both
    if not union:
        return Decimal(1)
    part, rest = divmod(both * 10_000, union)
    return Decimal(part + (2 * rest > union or (2 * rest == union and part % 2 == 1))).scaleb(-4)  # half to even


def similarity(pairs: DataFrame, key: str, one: str, other: str) -> DataFrame:
    """Key and ``jaccard`` of the shingles of two normalised texts, whose sets are made where the pair lies."""
    small_batches(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_share(x.as_py(), y.as_py()) for x, y in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.decimal128(6, 4))], [key, "similarity"])

    kind = pairs.schema[key].dataType.simpleString()
    return pairs.select(key, one, other).mapInArrow(run, f"{key} {kind}, similarity decimal(6,4)")


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def readability(text: Column) -> Column:
    """Struct of word, sentence and paragraph counts with a score and a grade."""
    empty = blank(text)

    def counts(parts: Column) -> Column:
        return F.struct(
            F.size(word_list(text)).alias("words"),
            F.greatest(F.size(parts), F.lit(1)).alias("sentences"),
            F.size(F.filter(parts, lambda s: F.size(word_list(s)) > 25)).alias("long"),
            F.greatest(F.size(F.filter(F.split(text, "\r\n\r\n|\n\n"), lambda p: p != "")), F.lit(1)).alias("paragraphs"),
        )

    def shares(c: Column) -> Column:
        average = F.bround(c["words"].cast("decimal(18,6)") / c["sentences"], 1)
        long_share = F.bround(c["long"].cast("decimal(18,6)") / c["sentences"] * 100, 1)
        return F.struct(c.alias("c"), average.alias("average"), long_share.alias("long_share"))

    def measured(m: Column) -> Column:
        raw = 100 - F.greatest(m["average"] - 15, F.lit(0)) * 2 - m["long_share"] * F.lit("0.4").cast("decimal(3,1)")
        score = F.bround(F.greatest(F.least(raw, F.lit(100)), F.lit(0)), 1)
        grade = F.when(score >= 75, "Easy").when(score >= 55, "Standard").when(score >= 35, "Difficult").otherwise("VeryDifficult")
        c = m["c"]
        return F.struct(
            c["words"].cast("int").alias("words"),
            c["sentences"].cast("int").alias("sentences"),
            m["average"].cast("decimal(10,1)").alias("average_sentence"),
            c["long"].cast("int").alias("long_sentences"),
            m["long_share"].cast("decimal(10,1)").alias("long_share"),
            c["paragraphs"].cast("int").alias("paragraphs"),
            score.cast("decimal(5,1)").alias("score"),
            grade.alias("grade"),
        )

    zero = lambda kind: F.lit(0).cast(kind)
    nothing = F.struct(
        zero("int").alias("words"), zero("int").alias("sentences"), zero("decimal(10,1)").alias("average_sentence"), zero("int").alias("long_sentences"),
        zero("decimal(10,1)").alias("long_share"), zero("int").alias("paragraphs"), zero("decimal(5,1)").alias("score"), F.lit("VeryDifficult").alias("grade"),
    )
    parts = F.filter(F.split(text, r"(?U)(?<=[.!?؟;\n])\s+"), lambda s: s.rlike(r"(?U)\S"))
    return F.when(empty, nothing).otherwise(once(once(once(parts, counts), shares), measured))


TERMS = "array<struct<term:string,n:int,hundredths:bigint,size:int,stuffing:boolean>>"
_STOP = frozenset(STOP_WORDS)


def _number(word: str) -> bool:
    return word.isascii() and word.isdigit() and int(word) < 1 << 31


def _terms(words: list[str], limit: int) -> list[tuple[str, int, int, int, bool]]:
    """The most frequent words and word pairs of one text: term, count, density in hundredths of a percent, words, stuffing."""
    total = len(words)
    counts = Counter((w, 1) for w in words if len(w) >= 3 and w not in _STOP and not _number(w))
    counts.update((f"{a} {b}", 2) for a, b in pairwise(words) if len(a) >= 2 and len(b) >= 2 and not (a in _STOP and b in _STOP))
    found = []
    for (term, size), n in counts.items():
        if n >= 2:
            part, rest = divmod(n * size * 10_000, total)
            part += 2 * rest > total or (2 * rest == total and part % 2)  # half to even
            found.append((term, n, part, size, (part >= 350 and n >= 4) if size == 1 else (part >= 250 and n >= 3)))
    return heapq.nsmallest(limit, found, key=lambda f: (-f[1], -f[2], f[3], f[0]))


def key_terms(text: Column, limit: int = 30) -> Column:
    """Array of a text's most frequent words and word pairs (``TERMS``), counted where the text lies."""

    @F.pandas_udf(TERMS)
    def terms(words: pd.Series) -> pd.Series:
        fields = ("term", "n", "hundredths", "size", "stuffing")
        return words.map(lambda w: [dict(zip(fields, f, strict=True)) for f in _terms(list(w), limit)] if w is not None else [])

    return terms(F.transform(word_list(text), F.lower))


def stuffed(text: Column) -> Column:
    """Whether any of a text's key terms is repeated too often."""
    return F.coalesce(F.exists(key_terms(text), lambda t: t["stuffing"]), F.lit(False))


def top_terms(pages: DataFrame, id_col: str = "page_id", text_col: str = "text", limit: int = 30) -> DataFrame:
    """The most frequent words and word pairs of each page: term, n, density (%), size, stuffing, rank."""
    rows = pages.select(F.col(id_col), F.posexplode(key_terms(F.col(text_col), limit)).alias("pos", "t"))
    density = (F.col("t.hundredths").cast("decimal(12,0)") / 100).cast("decimal(10,2)")
    return rows.select(id_col, "t.term", F.col("t.n").cast("bigint").alias("n"), density.alias("density"), "t.size", "t.stuffing", (F.col("pos") + 1).alias("rank"))


def clean_topic(title: Column) -> Column:
    """First part of a title cut at dashes, bars, dots and colons."""
    parts = F.filter(F.transform(F.split(title, r"[-|•:—]"), utrim), lambda p: p != "")
    return F.when(blank(title), F.lit("")).otherwise(F.coalesce(F.try_element_at(parts, F.lit(1)), utrim(title)))


def is_generic_anchor(anchor: Column) -> Column:
    return F.coalesce(F.lower(utrim(anchor)).isin(GENERIC_ANCHORS), F.lit(False))


def csv_safe(value: Column) -> Column:
    """A cell that a spreadsheet doesn't take for a formula."""
    quoted = F.replace(value, F.lit('"'), F.lit('""'))
    return F.when(value.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), quoted)).otherwise(quoted)
