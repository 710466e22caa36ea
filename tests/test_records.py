"""Alerts, written rows, comparisons, structured data, streams and sitemaps on small cases."""

import json
import time

from pyspark.sql import functions as F

from sitelens.functions import evidence, text
from sitelens.operators.duplicates import duplicate_clusters
from sitelens.operators.rules import Rule, evaluate_rules
from sitelens.plans import accounts, snapshots
from sitelens.sources import ingest, tables
from sitelens.streaming import streams


def opened(blocks: list[str | None]) -> tuple[list[dict], bool]:
    """Objects of structured data blocks, with arrays, graphs and JSON inside strings opened; whether all could be read."""
    found: list[dict] = []
    valid = True
    todo = [(b, 1) for b in reversed(blocks)]
    while todo:
        value, depth = todo.pop()
        if depth > evidence.DEPTH:
            valid = False
        elif isinstance(value, str):
            try:
                todo.append((json.loads(value), depth + 1))
            except (ValueError, RecursionError):
                valid = False
        elif isinstance(value, list):
            todo.extend((x, depth + 1) for x in reversed(value))
        elif isinstance(value, dict):
            found.append(value)
            if "@graph" in value:
                todo.append((value["@graph"], depth + 1))
        else:
            valid = False
    return found, valid


def test_alerts_count_shared_titles_and_carry_a_payload(spark):
    rules = spark.createDataFrame([(1, 7, "CANNIBALIZATION_DETECTED", 0, True), (2, 7, "SCORE_DROP", 5, True), (3, 7, "THIN_CONTENT_SPIKE", 0, True), (4, 8, "THIN_CONTENT_SPIKE", 0, True), (5, 7, "CRAWL_FAILURE", 0, False)], "rule_id int, project_id int, type string, threshold int, is_enabled boolean")
    scores = spark.createDataFrame([(7, 1, 80.0, 1), (7, 2, 74.0, 2)], "project_id int, crawl_id int, overall double, created_at int")
    crawls = spark.createDataFrame([(7, 1, "Completed", 1), (7, 2, "Failed", 2)], "project_id int, crawl_id int, status string, created_at int")
    found = spark.createDataFrame([(7, 2, "Open", "High", "DUPLICATE_TITLE_TAG"), (7, 1, "Open", "Critical", "X")], "project_id int, crawl_id int, status string, severity string, code string")
    fired = {r.rule_id: json.loads(r.payload) for r in accounts.alert_check(rules, scores, crawls, found).collect()}
    assert set(fired) == {1, 2, 3}
    assert fired[2] == {"rule": "SCORE_DROP", "score": 74.0, "previousScore": 80.0, "crawlId": 2}


TIMES = ["2024-01-01 00:00:00", "2024-01-01 12:00:00", "2024-01-02 00:00:00", "2024-01-02 00:00:01", "2024-01-09 00:00:00", "2024-01-09 23:59:59", "2024-01-10 00:00:01"]
#: 24 hours to the second are still too near.
EMITTED = {0, 3, 4, 6}


def test_alerts_are_a_chain_in_a_batch_and_in_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(i, r, t) for r in (1, 2) for i, t in enumerate(TIMES)], "event_id bigint, rule_id bigint, t string").select("event_id", "rule_id", F.to_timestamp("t").alias("detected_at"))
    old = spark.createDataFrame([(2, "2024-01-08 00:00:00")], "rule_id bigint, t string").select("rule_id", F.to_timestamp("t").alias("detected_at"))
    found = {(r.rule_id, r.event_id) for r in accounts.alert_cooldown(rows, old).collect()}
    # The stored event of rule 2 bars the one exactly a day later, so the next ones go on from there.
    assert found == {(1, i) for i in EMITTED} | {(2, i) for i in (0, 3, 5)}
    source = str(tmp_path / "in")
    rows.orderBy(F.desc("detected_at")).coalesce(1).write.parquet(source)
    out = str(tmp_path / "out")
    with streams.rocksdb(spark):
        streams._append(streams.stream_alerts(spark.readStream.schema(rows.schema).parquet(source), expires=False), out, str(tmp_path / "state")).awaitTermination()
    assert {(r.rule_id, r.event_id) for r in spark.read.parquet(f"{out}/epoch=*").collect()} == {(k, i) for k in (1, 2) for i in EMITTED}


def test_stored_events_bar_by_bins(spark):
    """One rule with very many events, against a comparison of all pairs; 24 hours to the second still bar."""
    import random

    rng = random.Random(2)
    events = [(1, rng.randrange(0, 40 * 86_400, 1_800)) for _ in range(60)] + [(2, 86_400)]
    asked = [(i, rng.choice((1, 2, 3)), rng.randrange(0, 40 * 86_400, 900)) for i in range(500)] + [(900, 2, 2 * 86_400), (901, 2, 2 * 86_400 + 1), (902, 2, 86_399)]
    frame = lambda rows, names: spark.createDataFrame(rows, f"{names} bigint, t bigint").withColumn("detected_at", F.timestamp_seconds("t")).drop("t")
    free = accounts._unbarred(frame(asked, "event_id bigint, rule_id"), frame(events * 50, "rule_id"), 86_400_000_000)
    want = {i for i, r, t in asked if not any(q == r and t - 86_400 <= u <= t for q, u in events)}
    assert sorted(r.event_id for r in free.collect()) == sorted(want)


def _state_rows(query):
    return query.lastProgress["stateOperators"][0]["numRowsTotal"] if query.lastProgress else 0


def test_state_goes_when_its_time_has_passed(spark, tmp_path):
    """Keys of metrics behind the watermark, and gates of rules that fell silent."""
    source, schema = str(tmp_path / "in"), "k int, at timestamp"
    day = lambda d: F.timestamp_seconds(F.lit(d * 86_400))
    kept = []
    for d in (1, 1, 2, 30, 31, 32):
        spark.range(50).select((F.col("id") + 100 * d).cast("int").alias("k"), day(d).alias("at")).write.mode("append").parquet(source)
        query = streams.stream_new_rows_within(spark.readStream.schema(schema).parquet(source), ["k"], "at", "3 days", str(tmp_path / f"out-{len(kept)}"), str(tmp_path / "state"))
        query.awaitTermination()
        kept.append(_state_rows(query))
    assert max(kept) <= 250 and kept[-1] < 200  # 50 keys a day; those of days 1 and 2 are gone
    rows = sum(spark.read.schema(schema).parquet(str(tmp_path / f"out-{i}") + "/epoch=*").count() for i in range(6) if any((tmp_path / f"out-{i}").glob("epoch=*/*.parquet")))
    assert rows == 250

    alerts, schema = str(tmp_path / "alerts"), "event_id bigint, rule_id bigint, detected_at timestamp"
    with streams.rocksdb(spark):
        for i, rule in enumerate((1, 1, 2)):
            time.sleep(3 if i == 2 else 0)
            spark.sql(f"SELECT {i}L AS event_id, {rule}L AS rule_id, current_timestamp() AS detected_at").write.mode("append").parquet(alerts)
            gate = streams.stream_alerts(spark.readStream.schema(schema).parquet(alerts), hours=2 / 3600)
            query = streams._append(gate, str(tmp_path / "events"), str(tmp_path / "gate"))
            query.awaitTermination()
    assert _state_rows(query) <= 2


def test_new_addresses_come_once_over_restarts(spark, tmp_path):
    known = spark.createDataFrame([(1, "https://tea.test/known")], "crawl_id int, normalized_url string")
    source, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    schema = "crawl_id int, target_url string, depth int, project_host string"
    for k, urls in enumerate((["https://tea.test/a", "https://tea.test/known"], ["https://tea.test/a#x", "https://tea.test/b", "https://other.test/"])):
        spark.createDataFrame([(1, u, k, "tea.test") for u in urls], schema).write.mode("append").parquet(source)
        streams.stream_discover(spark.readStream.schema(schema).parquet(source), known, out, state).awaitTermination()
    assert sorted((r.normalized_url, r.depth) for r in spark.read.parquet(f"{out}/epoch=*").collect()) == [("https://tea.test/a", 1), ("https://tea.test/b", 2)]


def test_usage_is_by_calendar_month(spark):
    rows = spark.createDataFrame([(1, "2024-01-31 23:59:59"), (1, "2024-02-01 00:00:00"), (1, "2024-01-01 00:00:00")], "owner_id int, t string").select("owner_id", F.to_timestamp("t").alias("ts"))
    assert sorted((str(r.month), r.pages) for r in streams.stream_counts(rows).collect()) == [("2024-01-01 00:00:00", 2), ("2024-02-01 00:00:00", 1)]


def test_written_rows_of_a_run_without_findings_go(spark, tmp_path):
    path = str(tmp_path / "issues")
    rows = spark.createDataFrame([(1, "rule", "a"), (1, "advisory", "b"), (2, "rule", "c")], "crawl_id int, source string, code string")
    tables.write_crawl_rows(rows, path, [1, 2], "source")
    tables.write_crawl_rows(rows.limit(0), path, [1], "source", spare=("source=advisory",))
    assert {r.code for r in spark.read.parquet(path).collect()} == {"b", "c"}


def test_structured_data_in_strings_and_deep_graphs():
    deep = {"@type": "Person"}
    for _ in range(6):
        deep = {"@graph": [deep]}
    found, valid = opened([json.dumps(json.dumps([deep, {"@type": ["A", 3]}])), json.dumps({"datePublished": None, "@type": "B"})])
    assert valid and [o["@type"] for o in found if "@type" in o] == ["Person", ["A", 3], "B"]
    for _ in range(9):
        deep = [deep]
    assert not opened([json.dumps(deep)])[1]
    assert opened(["{"]) == ([], False) and opened(["3"]) == ([], False) and opened([]) == ([], True)


def test_structured_data_column(spark):
    rows = spark.createDataFrame([(1, ['{"@type":"A","author":"x"}', "{"]), (2, None), (3, [])], "id int, b array<string>")
    found = {r.id: r.d for r in rows.select("id", evidence.structured_data(F.col("b")).alias("d")).collect()}
    assert (found[1].types, found[1].dated, found[1].valid) == (["A"], True, False)
    assert found[3].types == [] and found[3].valid and found[2].types == []


def test_structured_data_in_the_jvm_equals_the_parser(spark):
    """Graphs, arrays, dates, JSON in strings, broken blocks and other values, nested at random."""
    import random

    rng = random.Random(8)

    def value(depth):
        kind = rng.random()
        if depth > 5 or kind < 0.15:
            return rng.choice([3, None, True, "text", 1.5, '{"@type":"InText"}', "[]"])
        if kind < 0.35:
            return [value(depth + 1) for _ in range(rng.randint(0, 3))]
        out = {}
        if rng.random() < 0.7:
            out["@type"] = rng.choice(["A", "FAQPage", ["B", 2, "C"], [], 5, None, {"x": 1}])
        if rng.random() < 0.3:
            out[rng.choice(["author", "datePublished", "dateModified"])] = rng.choice(["x", None, {"@type": "Person"}, 3])
        if rng.random() < 0.4:
            out["@graph"] = value(depth + 1)
        return out

    rows = [(i, [rng.choice(["{", None, json.dumps(value(0)), json.dumps(value(0))]) for _ in range(rng.randint(0, 3))]) for i in range(400)] + [(400, None)]
    found = spark.createDataFrame(rows, "id int, b array<string>").select("id", evidence.structured_data(F.col("b")).alias("d")).collect()
    for r in found:
        objects, valid = opened(rows[r.id][1] or [])
        kinds = [o["@type"] for o in objects if "@type" in o]
        types = [t for k in kinds for t in (k if isinstance(k, list) else [k]) if isinstance(t, str)]
        assert (sorted(r.d.types), r.d.valid) == (sorted(types), valid), rows[r.id]
        assert r.d.dated == any(o.get(k) is not None for o in objects for k in ("author", "datePublished", "dateModified")), rows[r.id]


def test_a_rule_of_ones_own_reads_no_text(spark):
    own = Rule("NO_TEAPOT", "Content", "Low", lambda: ~F.col("title").contains("teapot"), "title", lambda: F.col("title"), "A teapot")
    pages = spark.createDataFrame([(1, 1, "a teapot", True), (1, 2, "a cup", True), (1, 3, "a cup", False)], "crawl_id int, page_id int, title string, has_snapshot boolean")
    found = evaluate_rules(pages, [own])
    assert {(r.page_id, r.triggered, r.evidence.actual) for r in found.collect()} == {(1, False, "a teapot"), (2, True, "a cup")}


def test_key_terms_break_ties_by_density_size_and_text(spark):
    body = "tea tea cup cup tea pot 12 12 the the of of a a"
    rows = spark.createDataFrame([(1, body), (2, ""), (3, None)], "page_id int, text string")
    found = [(r.term, r.n, float(r.density), r.size) for r in text.top_terms(rows).orderBy("page_id", "rank").collect()]
    assert found[0] == ("tea", 3, 21.43, 1) and found[-1] == ("cup", 2, 14.29, 1)
    assert [r.n for r in rows.select(F.size(text.key_terms(F.col("text"))).alias("n")).collect()] == [2, 0, 0]


def test_comparisons_refuse_captures_without_data(spark):
    states = spark.createDataFrame([(1, "Available", 4, ["faq"]), (2, "Partial", 2, ["map"]), (3, "Unavailable", None, [])], "snapshot_id int, availability string, own_position int, features array<string>")
    results = spark.createDataFrame([(1, "https://a.test/", 1), (1, "https://b.test/", 4), (2, "https://b.test/", 2), (2, "https://c.test/", 3)], "snapshot_id int, url string, position int")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (3, 2)], "from_id int, to_id int")
    totals, moved = snapshots.serp_changes(states, results, pairs)
    assert [(r.from_id, r.to_id, r.position_delta, r.movement, r.features_added, r.features_removed) for r in totals.collect()] == [(1, 2, 2, "improved", ["map"], ["faq"])]
    assert [(r.key, r.delta, r.kind) for r in moved.orderBy("rank").collect()] == [("b.test", 2, "improved"), ("a.test", None, "dropped"), ("c.test", None, "entered")]
    totals, links = snapshots.backlink_changes(
        spark.createDataFrame([(1, "Available", 4, None), (2, "Partial", 6, 2), (3, "Unavailable", 1, 1)], "snapshot_id int, availability string, referring_domains int, total_backlinks int"),
        spark.createDataFrame([(1, " http://A.test/", "/x"), (2, "http://b.test/", "/x"), (3, "http://c.test/", "/x")], "snapshot_id int, source_url string, target_url string"), pairs,
    )
    assert [(r.from_id, r.to_id, r.referring_domains_delta, r.total_backlinks_delta) for r in totals.collect()] == [(1, 2, 2, None)]
    assert sorted((r.key, r.change) for r in links.collect()) == [("http://a.test/|/x", "removed"), ("http://b.test/|/x", "added")]


def test_clusters_compare_all_their_texts_in_blocks(spark, monkeypatch):
    import sitelens.operators.duplicates as d

    words = [f"w{i}" for i in range(60)]
    docs = [(k, " ".join(words[:55] + [f"x{k}"] + words[56 : 56 + k])) for k in range(4)] + [(9, " ".join(words))]
    first = sorted(map(str, duplicate_clusters(spark.createDataFrame(docs, "doc_id int, text string"), 0.8).collect()))
    monkeypatch.setattr(d, "BLOCK", 2)
    assert first == sorted(map(str, duplicate_clusters(spark.createDataFrame(docs, "doc_id int, text string"), 0.8).collect()))


def test_sitemaps_follow_their_children(spark, tmp_path):
    index = "<sitemapindex><sitemap><loc>https://tea.test/{}.xml</loc></sitemap></sitemapindex>"
    urls = "<urlset><url><loc>https://tea.test/{}</loc><priority>0.5</priority></url></urlset>"
    files = {"root": index.format("a"), "a": index.format("b"), "b": urls.format("page")}
    for name, body in files.items():
        (tmp_path / f"{name}.xml").write_text(body)
    landed = spark.createDataFrame([(f"https://tea.test/{n}.xml", str(tmp_path / f"{n}.xml")) for n in files], "location string, path string")
    paths = ingest.sitemap_documents(landed, ["https://tea.test/root.xml"])
    assert [p.split("/")[-1] for p in paths] == ["root.xml", "a.xml", "b.xml"]
    assert len(ingest.sitemap_documents(landed, ["https://tea.test/root.xml"], 2)) == 2
    assert [r.location for r in ingest.sitemap_urls(spark, paths).collect()] == ["https://tea.test/page"]
