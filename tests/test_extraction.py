"""Extraction of evidence from any markup."""

import random

import pytest
from pyspark.sql import functions as F

from sitelens.functions import extract
from sitelens.functions.extract import extract_pages, page_row

PAGE = """<!DOCTYPE html><!-- <title>no</title> --><html lang="fa"><head><title> a
 page </title><title>second</title><meta name="Description" content=" d  e "><meta name="description" content="late">
<link rel="x CANONICAL" href="/c"><meta property="og:title" content="OG"><meta property="OG:title" content="late">
<script type="application/ld+json">{"@type":"Article"}</script></head><body><h2>Two <i>parts</i></h2><h1>One</h1>
<a href="/about" rel="nofollow">Ab<i>out</i></a><a name="x">none</a><img src=" a.jpg " alt=" "><script>window.evil=true</script>
<p>un<b>believ</b>able</p><template><h1>hidden</h1>hidden</template><a href="">here<a href="mailto:x@y">mail</body></html>"""


def test_text_content_and_first_elements():
    row = page_row("https://example.com/page", PAGE)
    assert (row["title"], row["meta_description"], row["canonical"], row["language"]) == ("a page", "d e", "https://example.com/c", "fa")
    assert [(h["level"], h["text"]) for h in row["headings"]] == [(2, "Two parts"), (1, "One")] and row["h1"] == "One"
    assert "unbelievable" in row["text"] and "hidden" not in row["text"] and "evil" in row["text"]
    assert [(x["href"], x["anchor"]) for x in row["links"]] == [("https://example.com/about", "About"), ("https://example.com/page", "here"), ("mailto:x@y", "mail")]
    assert row["open_graph"] == {"og:title": "OG"} and row["json_ld"] == ['{"@type":"Article"}']
    assert (row["image_count"], row["missing_alt"], row["assets"][0]["url"], row["error"]) == (1, 1, "https://example.com/a.jpg", None)


def test_a_word_split_by_tags_counts_once():
    assert page_row("https://a/", "<p>un<b>believ</b>able words</p>")["word_count"] == 2


@pytest.mark.parametrize(
    ("url", "html", "text"),
    [
        ("http://[bad/", "<p>x <a href='/y'>l</a>", "x l"), ("https://a/", "<![foo bar", ""), ("https://a/", "<p>a<![if x]>b<!ELEMENT c>d", "abd"), ("https://a/", "<" * 60 + "\x00&#x110000;&#xD800;", None),
        ("https://a/", "<a href='http://[x'>q</a>", "q"), (None, None, ""), ("", "", ""), ("https://a/", "<div " * 2000, None), ("https://a/", "<b>" * 5000 + "deep", "deep"), ("https://a/", "plain", "plain"),
    ],
)
def test_junk_gives_a_row(url, html, text):
    row = page_row(url, html)
    assert row["error"] is None or row["error"].startswith("url:") == (url == "http://[bad/")
    if text is not None:
        assert row["text"] == text


def test_bad_pages_do_not_end_the_job(spark, monkeypatch):
    monkeypatch.setattr(extract, "TOGETHER", 1_000)
    rows = [(1, "http://[bad/", "<h1>a</h1>"), (2, "https://a/", "<![foo "), (3, "https://a/", "<p>" + "word " * 50_000), (4, None, None), (5, "https://a/b", PAGE)]
    found = {r.page_id: r for r in extract_pages(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert sorted(found) == [1, 2, 3, 4, 5]
    assert found[1].error.startswith("url:") and found[1].h1 == "a" and found[3].word_count == 50_000 and found[4].text == "" and found[5].open_graph == {"og:title": "OG"}
    assert extract_pages(spark.createDataFrame([], "page_id int, url string, html string")).count() == 0


def test_runs_of_inert_tags_read_as_single_ones(monkeypatch):
    """Any mixture of tags, references, comments and text gives what reading tag by tag gives."""
    rng = random.Random(3)
    parts = ["<b>", "</b>", "<P>", "</p >", "<br/>", "<br />", '<div class="a&amp;b>c">', '<span title="x" id="y">', "<span title='x'>", "<b", "</b", "<", ">", "&", "&amp", "&amp;", "p;", " ", "w", "\n", "<!-- <b> -->",
             "<!x>", "<title>", "</title>", "<h1>", "</h1>", "<h2>", '<a href="/x">', "</a>", "<template>", "</template>", "<script>", "</script>", "<noscript>", "<body>", "</body>", "<textarea>", "</textarea>", '<img alt="<i>">', "<bold>", "<i\t>", "\0"]
    pages = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(5_000)]
    found = [page_row("https://a/", p) for p in pages]
    monkeypatch.setattr(extract._Page, "run_from", lambda self, i: None)
    assert found == [page_row("https://a/", p) for p in pages]


def test_small_files_of_large_pages_are_dealt_over_tasks(spark, tmp_path):
    """A page may be a thousand times its row in the file, which Spark reads as one partition."""
    from sitelens.plans.views import view

    spark.range(12_000).select(F.col("id").alias("p_partkey"), F.lit("n").alias("p_name"), F.lit("b").alias("p_brand"), F.lit("t").alias("p_type"), F.lit(1).alias("p_size"), F.lit(1.0).alias("p_retailprice")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    sizes = view(spark, str(tmp_path), "v_markup").groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= 3 and max(r["count"] for r in sizes) < 6_000


def test_visibility_reads_pages_once(spark):
    from sitelens.plans.catalog_pages import QUERIES

    plan = QUERIES["site_visibility"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan


def test_wanted_evidence_without_page_texts(spark):
    """Evidence that isn't made of page texts is the same without them, and they aren't gathered for it."""
    html = '<head><title>a <b>b</b></title><script type="application/ld+json">{"@type":"x"}</script><meta property="og:title" content="t"><link rel="alternate" hreflang="de" href="/de"></head><body><h1>h</h1><p>' + "<b>w</b> text " * 50
    html += '<a href="/x">in<i>side</i></a><img src="/i.png" alt="y"><p>more &amp; more'
    whole, some = extract.page_row("https://x.example/", html), extract.page_row("https://x.example/", html, texts=False)
    assert {k: v for k, v in some.items() if k not in ("h1", "headings")} == {k: v for k, v in whole.items() if k not in ("h1", "headings", "text", "word_count")}
    rows = spark.createDataFrame([(1, "https://x.example/", html), (2, None, None)], "page_id int, url string, html string")
    every = {r.page_id: r for r in extract.extract_pages(rows).collect()}
    for r in extract.extract_pages(rows, wanted=extract.META).collect():
        assert all(r[c] == every[r.page_id][c] for c in r.__fields__) and set(r.__fields__) == {"page_id", "url", *extract.META, "error"}
