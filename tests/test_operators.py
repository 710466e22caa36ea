"""Rules, scores, links, duplicates, robots, reports and streams on small cases."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from sitelens.functions.extract import extract_pages, page_links
from sitelens.operators import links as links_module
from sitelens.operators.components import connected_components
from sitelens.operators.duplicates import duplicate_clusters
from sitelens.operators.links import internal_authority, link_graph
from sitelens.operators.robots import crawl_delay, discover_urls, robots_allowed, robots_policy, robots_rules
from sitelens.operators.rules import evaluate_rules
from sitelens.operators.scoring import scores
from sitelens.plans import accounts, snapshots, visibility
from sitelens.sources import ingest
from sitelens.streaming import streams

PERFECT = {
    "crawl_id": 1, "page_id": 1, "url": "https://example.com/page", "title": "A good title of thirty-eight characters", "meta_description": "d" * 110, "canonical": "https://example.com/page",
    "robots_meta": "index", "x_robots": None, "content_type": "text/html", "status": 200, "response_ms": 400, "depth": 1, "word_count": 600, "missing_alt": 0, "has_snapshot": True, "is_indexable": True,
    "text": "", "headings": [(1, "h"), (2, "h"), (3, "h")], "assets": [], "json_ld": ['{"@context":"x","@type":"Organization"}'], "hreflang": [("en", "https://example.com/page")],
    "headers": {"Strict-Transport-Security": ["x"], "X-Content-Type-Options": ["nosniff"], "X-Frame-Options": ["DENY"], "Cache-Control": ["x"]}, "redirects": [],
}
_ASSET = "struct<type:string,url:string,mixed:boolean,width:string,height:string,is_async:boolean,is_defer:boolean>"
PAGE = (
    "crawl_id int, page_id int, url string, title string, meta_description string, canonical string, robots_meta string, x_robots string, content_type string, status int, response_ms int, depth int, word_count int, "
    f"missing_alt int, has_snapshot boolean, is_indexable boolean, text string, headings array<struct<level:int,text:string>>, assets array<{_ASSET}>, json_ld array<string>, "
    "hreflang array<struct<language:string,target:string>>, headers map<string,array<string>>, redirects array<string>"
)
SCRIPT, ASYNC, IMAGE, MIXED = ("Script", "u", False, None, None, False, False), ("Script", "u", False, None, None, True, False), ("Image", "u", False, None, None, False, False), ("Iframe", "u", True, None, None, False, False)
CASES = [
    ({}, set()), ({"title": "   "}, {"TITLE_MISSING"}), ({"title": "abc"}, {"TITLE_LENGTH"}), ({"title": "t" * 120}, {"TITLE_LENGTH"}), ({"headings": [(2, "h")]}, {"H1_MISSING"}),
    ({"headings": [(1, "a"), (1, "b")]}, {"MULTIPLE_H1"}), ({"headings": [(1, "a"), (3, "b")]}, {"HEADING_STRUCTURE"}), ({"canonical": None}, {"CANONICAL_MISSING"}),
    ({"canonical": "/relative/path"}, {"CANONICAL_INVALID"}), ({"canonical": "https://example.com/other"}, {"CANONICAL_MISMATCH"}), ({"canonical": "HTTPS://EXAMPLE.com:443/page/"}, set()),
    ({"status": 404}, {"BROKEN_STATUS"}), ({"status": 301}, {"REDIRECTED_PAGE"}), ({"redirects": ["a"] * 4}, {"REDIRECT_CHAIN_LONG"}), ({"redirects": ["a"] * 2}, set()),
    ({"assets": [MIXED]}, {"MIXED_CONTENT_ASSETS"}), ({"assets": [ASYNC] * 30}, {"EXCESSIVE_RESOURCES"}), ({"assets": [SCRIPT] * 5}, {"RENDER_BLOCKING_RESOURCES"}), ({"assets": [ASYNC] * 5}, set()),
    ({"assets": [IMAGE]}, {"IMAGE_DIMENSIONS_MISSING"}), ({"json_ld": ["{"]}, {"SCHEMA_SYNTAX_INVALID"}), ({"json_ld": ['{"name":1}']}, {"SCHEMA_SYNTAX_INVALID"}),
    ({"json_ld": ['{"@type":"Article","author":"a"}']}, {"SCHEMA_MISSING_REQUIRED"}), ({"json_ld": ['{"@type":"Product","name":"n"}']}, {"SCHEMA_MISSING_REQUIRED"}), ({"json_ld": []}, {"STRUCTURED_DATA_ABSENT"}),
    ({"hreflang": [("en", "https://example.com/other")]}, {"HREFLANG_NO_SELF_REFERENCE"}), ({"hreflang": [("فارسی", "https://example.com/page")]}, {"HREFLANG_INVALID_CODE"}), ({"hreflang": [("x-default", "https://example.com/page")]}, set()),
    ({"depth": 4}, {"DEEP_CLICK_DEPTH"}), ({"word_count": 80}, {"LOW_WORD_COUNT", "THIN_CONTENT"}), ({"word_count": 80, "is_indexable": False}, {"LOW_WORD_COUNT"}), ({"robots_meta": "NoIndex"}, {"NOINDEX"}),
    ({"x_robots": "noindex"}, {"X_ROBOTS_NOINDEX"}), ({"response_ms": 1501}, {"SLOW_RESPONSE"}), ({"missing_alt": 1}, {"ALT_MISSING"}), ({"content_type": " "}, {"CONTENT_TYPE_MISSING"}),
    ({"headers": {"Cache-Control": ["x"], "x-content-type-options": ["x"], "content-security-policy": ["x"]}}, {"HSTS_MISSING"}),
    ({"text": ". ".join(["spam " * 2 + " ".join(f"w{i}{j}" for j in range(14)) for i in range(8)])}, {"KEYWORD_STUFFING"}),
    ({"text": ". ".join([" ".join(f"w{i}{j}" for j in range(30)) for i in range(5)])}, {"CONTENT_LONG_SENTENCES"}),
    ({"has_snapshot": False, "title": None, "status": 500}, {"BROKEN_STATUS"}),
]


def test_each_rule_alone(spark):
    names = [c.split(" ")[0] for c in PAGE.split(", ")]
    rows = [tuple((PERFECT | change | {"page_id": i})[n] for n in names) for i, (change, _) in enumerate(CASES)]
    found = evaluate_rules(spark.createDataFrame(rows, PAGE))
    fired = {}
    for r in found.filter("triggered").collect():
        fired.setdefault(r.page_id, set()).add(r.code)
    for i, (change, expected) in enumerate(CASES):
        assert fired.get(i, set()) == expected, change
    assert found.filter(F.col("page_id") == len(CASES) - 1).count() == 9


@pytest.mark.parametrize("pages,fired,expected", [(100, 1, 99.8), (10, 9, 77.5)])
def test_score_falls_with_the_share(spark, pages, fired, expected):
    rows = [(1, i, "X", i < fired, "High", "OnPage") for i in range(pages)]
    one = scores(spark.createDataFrame(rows, "crawl_id int, page_id int, code string, triggered boolean, severity string, category string")).first()
    assert float(one.on_page) == expected and one.is_partial and one.technical is None and float(one.overall) == expected


def test_link_graph(spark):
    pages = spark.createDataFrame([(1, True, True), (2, False, True), (3, False, True), (4, False, True)], "page_id int, is_root boolean, in_seeds boolean")
    links = spark.createDataFrame([(1, 2, "x"), (2, 3, "x"), (1, 3, "x"), (1, 3, "y"), (9, 3, "z")], "source_id int, target_id int, anchor string")
    rows = {r.page_id: r for r in link_graph(pages, links).collect()}
    assert (rows[3].in_degree, rows[1].out_degree) == (2, 2)
    assert rows[4].is_orphan and not rows[1].is_orphan and rows[3].is_dead_end and rows[2].is_weak
    authority = {r.page_id: r.authority for r in internal_authority(pages, links).collect()}
    assert max(authority.values()) == 100.0 and authority[3] == 100.0 and authority[4] < authority[2]


def test_authority_of_many_pages_broadcasts_nothing(spark, monkeypatch):
    """Beyond the bound on pages every join is shuffled, with the same values."""
    pages = spark.range(300).select(F.col("id").alias("page_id"))
    links = pages.select(F.col("page_id").alias("source_id"), F.explode(F.array((F.col("page_id") * 7) % 300, (F.col("page_id") * 13 + 5) % 300)).alias("target_id")).filter("source_id % 10 <> 3")
    few = {r.page_id: r.authority for r in internal_authority(pages, links).collect()}
    plans, real = [], links_module.Scratch.save

    def seen(self, df, name):
        out = real(self, df, name)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(links_module.Scratch, "save", seen)
    monkeypatch.setattr(links_module, "BROADCAST_PAGES", 100)
    many = {r.page_id: r.authority for r in internal_authority(pages, links).collect()}
    assert many == few and len(few) == 300 and not any("BroadcastHashJoin" in p for p in plans) and any("SortMergeJoin" in p for p in plans)


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (7, 8), (6, 6), (8, 7), (None, 1)], "a int, b int")
    assert {r.node: r.component for r in connected_components(edges).collect()} == {3: 3, 4: 3, 5: 3, 9: 3, 7: 7, 8: 7}
    chain = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in connected_components(chain).collect()} == {0}


def test_duplicate_clusters(spark):
    words = " ".join(f"w{i}" for i in range(40))
    docs = [(1, "كتاب خوب است"), (2, "کتاب خوب است"), (3, "other text entirely"), (4, words), (5, words + " w40"), (6, ""), (7, " . "), (8, None)]
    rows = {r.cluster: r for r in duplicate_clusters(spark.createDataFrame(docs, "doc_id int, text string")).collect()}
    assert (rows[1].ids, rows[1].exact) == ([1, 2], True)
    assert rows[4].ids == [4, 5] and not rows[4].exact and float(rows[4].similarity) == 0.9744
    assert rows[6].ids == [6, 7, 8]


#: Two agents share a group, an empty rule, a rule with a star and an end, a comment, a delay that is too long.
ROBOTS = """# tea shop
User-agent: TeaBot
User-agent: KettleBot/2
Disallow: /cups  # all of them
Allow: /cups/blue$
Crawl-delay: 4

User-agent: *
Crawl-delay: 100000
Disallow: /*.bak$
Disallow: /till
Allow: /till/hours
Disallow:
Sitemap: https://tea.test/sitemap.xml
"""


def test_robots(spark):
    rules = robots_rules(spark.createDataFrame([("tea.test", ROBOTS)], "host string, body string")).cache()
    asked = [
        ("Mozilla TeaBot/1", "/cups", False), ("Mozilla TeaBot/1", "/cups/blue", True), ("Mozilla TeaBot/1", "/cups/blue/2", False), ("Mozilla TeaBot/1", "/till", True),
        ("Walker", "/cups", True), ("Walker", "/old/page.bak", False), ("Walker", "/old/page.bak2", True), ("Walker", "/till/x", False), ("Walker", "/till/hours?day=1", True),
    ]
    urls = spark.createDataFrame([("tea.test", a, "https://tea.test" + p) for a, p, _ in asked], "host string, user_agent string, url string")
    found = {(r.user_agent, r.url): r.allowed for r in robots_allowed(urls, rules).collect()}
    assert [found[a, "https://tea.test" + p] for a, p, _ in asked] == [x for _, _, x in asked]
    assert {r.user_agent: r.delay for r in crawl_delay(urls, rules).collect()} == {"Mozilla TeaBot/1": 4.0, "Walker": None}
    for policy, expected in (("disallow_all", {False}), ("unavailable", {False}), ("allow_all", {True})):
        policies = spark.createDataFrame([("tea.test", policy)], "host string, policy string")
        assert {r.allowed for r in robots_allowed(urls, rules, policies).collect()} == expected
    hosts = spark.createDataFrame([("tea.test", True), ("gone.test", False)], "host string, has_robots boolean")
    access = visibility.ai_crawler_access(hosts, rules, visibility.profiles(spark)).cache()
    assert {r.access for r in access.collect() if r.host == "tea.test"} == {"Unspecified"}
    assert {r.host: r.crawlability and float(r.crawlability) for r in visibility.ai_crawlability(access).collect()} == {"tea.test": 70.0, "gone.test": None}


def test_robots_policy(spark):
    rows = robots_policy(spark.createDataFrame([(200,), (403,), (503,), (None,), (404,)], "status int")).collect()
    assert [r.policy for r in rows] == ["parse", "disallow_all", "unavailable", "unavailable", "allow_all"]


def test_discovery(spark):
    targets = ["https://example.com/a#x", "https://EXAMPLE.com/a?utm_source=x", "https://evil-example.com/", "mailto:x", "https://sub.example.com/", "https://example.com.evil.test/", "https://u:p@example.com/b", "https://example.com/known"]
    links = spark.createDataFrame([(1, t, i, "example.com") for i, t in enumerate(targets)], "crawl_id int, target_url string, depth int, project_host string")
    known = spark.createDataFrame([(1, "https://example.com/known")], "crawl_id int, normalized_url string")
    assert [(r.normalized_url, r.depth) for r in discover_urls(links, known).collect()] == [("https://example.com/a", 1)]
    assert {r.normalized_url for r in discover_urls(links, known, subdomains=True).collect()} == {"https://example.com/a", "https://sub.example.com/"}


HTML = """<html lang="fa"><head><title> A  page </title><meta name="Description" content="d"><link rel="canonical" href="/canonical"><meta property="og:title" content="o"><meta property="og:title" content="p">
<link rel="alternate" hreflang="en" href="/en"><script type="application/ld+json">{"@type":"Article"}</script><script src="http://x.test/a.js" async></script><link rel="stylesheet" href="/s.css"></head>
<body><h1>Top</h1><h2></h2><h3>Low</h3><p>one two <a href="/in" rel="nofollow ugc">In  link</a> three</p><img src="i.png"><img src="j.png" alt="x" width="1" height="2"><a href="mailto:x">m</a><script>var skipped = 1;</script></body></html>"""


def test_extraction(spark):
    pages = spark.createDataFrame([(1, "https://example.com/dir/p", HTML), (2, "https://example.com/", None), (3, None, "<p>x")], "page_id int, url string, html string")
    found = extract_pages(pages).cache()
    one = found.filter("page_id = 1").first()
    assert (one.title, one.meta_description, one.canonical, one.language, one.h1) == ("A page", "d", "https://example.com/canonical", "fa", "Top")
    assert [(h.level, h.text) for h in one.headings] == [(1, "Top"), (3, "Low")]
    assert (one.text, one.word_count, one.image_count, one.missing_alt) == ("TopLowone two In link threemvar skipped = 1;", 7, 2, 1)
    assert json.loads(one.json_ld[0]) == {"@type": "Article"} and one.open_graph == {"og:title": "o"} and one.hreflang[0].target == "https://example.com/en"
    assert [(a.type, a.mixed, a.external) for a in one.assets] == [("Script", True, True), ("Stylesheet", False, False), ("Image", False, False), ("Image", False, False)]
    links = page_links(found).collect()
    assert [(x.normalized_target, x.anchor, x.is_internal, x.is_nofollow) for x in links] == [("https://example.com/in", "In link", True, True)]
    assert found.count() == 3


def test_snapshot_comparison(spark):
    schema = "k int, url string, position int"
    old = spark.createDataFrame([(1, "https://own.test/a/", 7), (1, "https://a.com/", 1), (1, "https://same.com/x", 3)], schema)
    new = spark.createDataFrame([(1, "https://OWN.test/a", 3), (1, "https://c.com/", 1), (1, "https://same.com/x", 3)], schema)
    rows = {r.key: (r.delta, r.kind) for r in snapshots.serp_compare(old, new, "k").collect()}
    assert rows == {"own.test/a": (4, "improved"), "a.com": (None, "dropped"), "c.com": (None, "entered"), "same.com/x": (0, "unchanged")}
    unknown = spark.createDataFrame([(1, "Available", None, 5)], "k int, availability string, referring int, total int")
    known = spark.createDataFrame([(1, "Available", 3, 8)], "k int, availability string, referring int, total int")
    row = snapshots.measured_deltas(unknown, known, ["referring", "total"], "k").first()
    assert (row.referring_delta, row.total_delta) == (None, 3)


def test_search_metrics_are_taken_once(spark):
    answer = {"rows": [{"keys": ["کتاب", "/a", "2024-01-02"], "clicks": 2.5, "impressions": 10.0, "ctr": 0.1, "position": 3.0}, {"keys": [" ", "/a", "2024-01-02"], "clicks": 1, "impressions": 1, "ctr": 1, "position": 1}]}
    raw = spark.createDataFrame([(json.dumps(answer),)], "json string")
    keywords = spark.createDataFrame([], "id string, project_id string, normalized_phrase string, country string")
    metrics = spark.createDataFrame([], "keyword_id string, date date, page_url string, country string, device string")
    fresh, made = ingest.ingest_search_metrics(raw, keywords, metrics, "p")
    assert fresh.count() == 1 and [(r.clicks, r.impressions) for r in made.collect()] == [(2, 10)]
    again = ingest.ingest_search_metrics(raw, fresh, made, "p")
    assert again[0].count() == 0 and again[1].count() == 0
    bad = spark.createDataFrame([(json.dumps({"rows": [{"keys": ["q", "/a", "2024-01-02"], "clicks": 1}]}),)], "json string")
    with pytest.raises(Exception, match="lacks a measurement"):
        ingest.search_rows(bad).collect()


def test_sitemaps(spark, tmp_path):
    (tmp_path / "m.xml").write_text(
        '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://example.com/a</loc><lastmod>2024-01-02</lastmod><changefreq>Daily</changefreq><priority>0.8</priority></url><url><loc>ftp://bad</loc></url><url><loc>https://example.com/b</loc><priority>high</priority></url></urlset>'
    )
    rows = ingest.sitemap_urls(spark, [str(tmp_path / "m.xml")]).collect()
    assert [(r.location, r.changefreq, r.priority and float(r.priority)) for r in rows] == [("https://example.com/a", "daily", 0.8), ("https://example.com/b", None, None)]


def test_usage_counts_own_live_projects_this_month(spark):
    projects = spark.createDataFrame([(1, 10, "Active"), (2, 10, "Archived"), (3, 11, "Active")], "project_id int, owner_id int, status string")
    crawls = spark.createDataFrame([(1, 1, dt.datetime(2024, 5, 3)), (2, 1, dt.datetime(2024, 4, 30)), (3, 2, dt.datetime(2024, 5, 3)), (4, 3, dt.datetime(2024, 5, 31))], "crawl_id int, project_id int, started_at timestamp")
    pages = spark.createDataFrame([(1,), (1,), (2,), (3,), (4,)], "crawl_id int")
    members = spark.createDataFrame([(1, 5), (1, 6), (3, 5)], "project_id int, user_id int")
    rows = {r.owner_id: r for r in accounts.usage(projects, crawls, pages, members, members, members, F.lit(dt.datetime(2024, 5, 20))).collect()}
    assert (rows[10].projects, rows[10].pages, rows[10].members) == (1, 2, 2) and rows[11].pages == 1


def test_advisories_keep_the_users_status(spark):
    schema = "crawl_id int, code string, status string, detail string"
    existing = spark.createDataFrame([(1, "A", "Ignored", "old"), (1, "B", "Open", "old"), (2, "A", "Open", "old")], schema)
    findings = spark.createDataFrame([(1, "A", "new"), (3, "A", "new")], "crawl_id int, code string, detail string")
    evaluated = spark.createDataFrame([(1, "A"), (1, "B"), (3, "A")], "crawl_id int, code string")
    rows = {(r.crawl_id, r.code): (r.status, r.detail) for r in visibility.sync_advisories(existing, findings, evaluated).collect()}
    assert rows == {(1, "A"): ("Ignored", "new"), (2, "A"): ("Open", "old"), (3, "A"): ("Open", "new")}


def test_stream_of_metrics_equals_the_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = spark.createDataFrame([(k % 7, k % 3) for k in range(60)], "k int, p int")
    rows.repartition(5).write.parquet(source)
    stream = spark.readStream.schema("k int, p int").option("maxFilesPerTrigger", 1).parquet(source)
    streams.stream_new_rows(stream, ["k", "p"], str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    out = spark.read.schema("k int, p int").parquet(str(tmp_path / "out") + "/epoch=*")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, rows.distinct().collect()))


def test_whole_tables_match_their_sql(spark):
    import duckdb

    from sitelens.plans.catalog import ORACLES, QUERIES

    directory = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for name in ("pages", "documents", "lineitem", "part", "supplier", "orders", "customer", "events"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{directory}/{name}.parquet'")
    for name in ("site_scores", "page_normalized_urls", "link_degrees", "keyword_summary", "competitor_topic_gaps", "serp_comparison", "account_usage"):
        got = QUERIES[name](spark, directory)
        rows = db.execute(ORACLES[name])
        order = [c[0] for c in rows.description]
        assert sorted(map(str, (tuple(r[c] for c in order) for r in got.collect()))) == sorted(map(str, rows.fetchall())), name


def test_every_part_is_a_keyword(spark):
    import duckdb

    from sitelens.plans.catalog import ORACLES, QUERIES

    directory = "/root/testdata/sf0.01"
    parts = spark.read.parquet(f"{directory}/part.parquet").count()
    db = duckdb.connect()
    for name in ("lineitem", "part"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{directory}/{name}.parquet'")
    for name in ("keyword_overview", "keyword_opportunities", "keyword_cannibalization", "keyword_summary", "keyword_history"):
        rows = db.execute(ORACLES[name])
        order = [c[0] for c in rows.description]
        got = [tuple(r[c] for c in order) for r in QUERIES[name](spark, directory).collect()]
        assert sorted(map(str, got)) == sorted(map(str, rows.fetchall())), name
        if name == "keyword_overview":
            assert len({r[order.index("keyword_id")] for r in got}) == len(got) == parts > 500


def test_whole_captures_are_compared(spark):
    from sitelens.plans.catalog import QUERIES

    directory = "/root/testdata/sf0.01"
    suppliers = spark.read.parquet(f"{directory}/supplier.parquet").count()
    rows = QUERIES["serp_comparison"](spark, directory).collect()
    assert len(rows) == suppliers and all((r.kind == "dropped") == (r.new_position is None) for r in rows)
    assert {r.kind for r in rows} == {"improved", "declined", "unchanged", "entered", "dropped"}
    assert max(r.old_position or 0 for r in rows) > 3 < max(r.new_position or 0 for r in rows)
