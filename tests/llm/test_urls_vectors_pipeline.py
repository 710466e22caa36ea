"""URL filters, embeddings and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelens.llm.embeddings import near_duplicate_vectors
from sitelens.llm.queries import URL_RULES
from sitelens.llm.urls import Rule, url_filter


def judged(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.host) + len(r.path), len(r.host), r.verdict == "block"), default=None)
    return host, path, best and best.host + best.path, best.verdict if best else "allow"


def test_url_filter_against_every_rule(spark):
    rng = random.Random(1)
    hosts = ["example.com", "www.example.com", "WWW.Example.com", "a.www.example.com", "net", "x.net", "notexample.com", "com", "example.org", "x.example.com:80", "user@x.net"]
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/en/1', '/es/', '/fr', '/fr/x?en', '#top', '?q=/en/'])}" for _ in range(300)]
    rows = [*enumerate([*urls, None, "", "no scheme", "http://", "://x.net/es/", "http://é.net/es/", "http://x.net/es/" + "a/" * 50_000, "http://" + "a." * 300 + "net/fr/"])]
    rules = [*URL_RULES, Rule("block", "org", "/e"), Rule("allow", "example.org", "/en"), Rule("block", "example.org", "/en")]
    for bits in (None, 10, 1):
        pages = spark.createDataFrame(rows, "page_id bigint, url string").withColumn("host", F.lit("clash")).withColumn("id", F.lit(1))
        found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter(pages, rules, bits_per_key=bits).collect()}
        assert found == {i: judged(u, rules) for i, u in rows}


def test_a_cascade_of_few_bits_has_levels_and_stays_exact(spark):
    from sitelens.llm.urls import Cascade
    from sitelens.plans.durable import Scratch

    key = lambda n: F.struct(F.concat(F.lit("h"), n.cast("string")).alias("host"), F.lit("/").alias("path")).alias("key")
    universe = spark.range(3000).select(key(F.col("id")))
    cascade = Cascade(Scratch(spark, "t"), spark.range(200).select(key(F.col("id") * 7)), universe, 3000, bits_per_key=2)
    assert len(cascade.levels) > 2
    words = {f"w{i}": c for i, c in enumerate(cascade.columns())}
    listed = universe.withColumns(words).filter(cascade.lists(F.col("key"), [F.col(c) for c in words])).select("key.host").collect()
    assert {r.host for r in listed} == {f"h{7 * i}" for i in range(200)}


def test_later_levels_follow_the_list_and_not_the_universe(spark, monkeypatch):
    import sitelens.llm.urls as m
    from sitelens.plans.durable import Scratch

    sizes = []
    level = m._level
    monkeypatch.setattr(m, "_level", lambda keys, n, number, bits: sizes.append((number, n)) or level(keys, n, number, bits))
    key = lambda n: F.struct(n.cast("string").alias("host"), F.lit("/").alias("path")).alias("key")
    m.Cascade(Scratch(spark, "t"), spark.range(5).select(key(F.col("id"))), spark.range(200_000).select(key(F.col("id"))), 200_000)
    assert all(n <= 5 + 15 for _, n in sizes)
    monkeypatch.setattr(m, "MAX_KEYS", 3)
    with pytest.raises(ValueError):
        m.Cascade(Scratch(spark, "t"), spark.range(5).select(key(F.col("id"))), spark.range(100).select(key(F.col("id"))), 100)


def test_url_filter_repeated_rows_and_null_ids(spark):
    pages = spark.createDataFrame([(None, "http://a.net/es/"), (None, None), (4, "http://a.net/es/"), (4, "http://a.net/es/")], "page_id bigint, url string")
    found = sorted((r.page_id or 0, r.host, r.rule or "", r.verdict) for r in url_filter(pages, URL_RULES).collect())
    assert found == [(0, "", "", "allow"), (0, "a.net", "net/es/", "block"), (4, "a.net", "net/es/", "block"), (4, "a.net", "net/es/", "block")]


def test_url_filter_empty(spark):
    none = spark.createDataFrame([], "page_id bigint, url string")
    assert url_filter(none, URL_RULES).collect() == []
    one = spark.createDataFrame([(1, "http://a.net/es/")], "page_id bigint, url string")
    assert [(r.rule, r.verdict) for r in url_filter(one, []).collect()] == [(None, "allow")]


def vectors():
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 24))
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(base)]
    for i in range(150):
        k = int(rng.integers(0, 8))
        rows.append((100 + i, (base[k] + rng.standard_normal(24) * 0.12).tolist(), int(rng.integers(0, 2))))
    rows += [(300, base[0].tolist(), 0), (301, (base[0] * 3).tolist(), 0), (302, base[0].tolist(), None)]
    rows += [(303, None, 1), (304, [], 1), (305, [0.0] * 24, 1), (306, [float("nan")] * 24, 1), (307, [None, *base[1].tolist()[1:]], 1), (308, base[0].tolist()[:12], 0)]
    return rows


def truth(rows):
    """Links of every vector and its component, by all pairs."""
    ok = lambda v: v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    unit = {}
    for i, v, x in rows:
        if i is not None and x is not None and ok(v):
            w = np.array(v) / np.abs(v).max()
            unit[i] = (x, w / np.linalg.norm(w))
    links = {i: set() for i, _, _ in rows}
    component = {i: i for i, _, _ in rows}

    def root(i):
        while component[i] != i:
            i = component[i]
        return i

    for i, (x, a) in unit.items():
        for j, (y, b) in unit.items():
            if i < j and x == y and len(a) == len(b) and a @ b >= 0.98:
                links[i].add(j)
                links[j].add(i)
                p, q = root(i), root(j)
                component[max(p, q)] = min(p, q)
    return links, {i: root(i) for i in component}


def test_vectors_against_all_pairs(spark, monkeypatch):
    import sitelens.llm.embeddings as m

    rows = vectors()
    rows += [(400, [1e200, 1e200, 0.0] * 8, 5), (401, [2e200, 2e200, 0.0] * 8, 5), (402, [1e-200, 1e-200, 0.0] * 8, 5), (403, [1e-320] + [0.0] * 23, 5), (404, [5e-324] + [0.0] * 23, 5)]
    rows += [(500 + i, (np.array(rows[0][1][:12]) + 0.02 * i).tolist(), 0) for i in range(6)]  # another length
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("id", F.lit(1)).withColumn("n", F.lit(1))
    links, component = truth(rows)
    total = sum(map(len, links.values()))
    assert total > 100 and links[400] == {401, 402} and links[403] == {404}
    for block in (1000, 5):
        monkeypatch.setattr(m, "BLOCK", block)
        found = {r.vec_id: r for r in near_duplicate_vectors(df).collect()}
        assert len(found) == len(rows)
        assert all(found[i].n_links <= len(links[i]) for i in links)
        assert sum(r.n_links for r in found.values()) >= 0.95 * total
        assert all(found[i].n_links == 0 and found[i].kept for i in range(302, 308))
        assert sum(found[i].component_id == c for i, c in component.items()) >= 0.97 * len(rows)
        assert all(r.kept == (r.component_id == i) for i, r in found.items())


def test_vectors_on_the_given_table(spark):
    """Recall of links, and components, against brute force over a whole table."""
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    links, component = truth(rows)
    found = {r.vec_id: r for r in near_duplicate_vectors(df).collect()}
    total = sum(map(len, links.values()))
    assert all(found[i].n_links <= len(links[i]) for i in links)
    assert sum(r.n_links for r in found.values()) >= 0.98 * total
    assert sum(found[i].component_id == c for i, c in component.items()) >= 0.99 * len(rows)


def test_vectors_repeated_rows_and_null_ids(spark):
    rows = [(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (None, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)]
    found = near_duplicate_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in found) == [(0, 0, 0, False), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False)]


def test_vectors_empty(spark):
    assert near_duplicate_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).collect() == []


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline as p

    directory = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{directory}/documents.parquet")
    n, columns = docs.count(), docs.columns
    extra = docs.filter("doc_id < 3").withColumn("doc_id", F.col("doc_id") + 100_000)
    near = docs.filter("n_chars between 2000 and 4000").orderBy("doc_id").limit(2).withColumns({"doc_id": F.col("doc_id") + 300_000, "text": F.concat("text", F.lit(" one more word"))})
    planted = {r.doc_id for r in near.collect()}
    docs = docs.unionByName(extra).unionByName(near).unionByName(docs.limit(1).withColumns({"doc_id": F.lit(200_000).cast("bigint"), "text": F.lit("123 ...")}))
    for name, stage in p.STAGES:
        out = stage(spark, docs, directory)
        if name != p.STAGES[-1][0]:
            assert out.columns == columns
        out = out.cache()
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        assert len(ids) == out.count() <= docs.count()
        if name == "language_id":
            assert 200_000 not in ids and len(ids) == n + 5
        if name == "exact_dedup":
            assert not ids & {100_000, 100_001, 100_002} and {0, 1, 2} & ids
            assert planted <= ids
        if name == "minhash_dedup":
            assert planted and not planted & ids and {i - 300_000 for i in planted} <= {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "source_mixing":
            words = lambda d: d.select(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0]
            assert 0.8 * words(docs) < words(out) <= 0.91 * words(docs)
        docs = out
    assert all(len(r.ids) == r.n_pieces for r in docs.collect())


def test_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline as p

    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    assert p.run(spark, str(tmp_path)).collect() == []


def rows_of(spark, docs):
    made = [(i, t, "en", "src0-a", len(t)) for i, t in docs]
    return spark.createDataFrame(made, "doc_id bigint, text string, lang string, source string, n_chars bigint")


def unlike(k):
    return " ".join(f"w{k}x{j}" for j in range(30))


def test_pipeline_stages_decide_by_row(spark):
    import corpus_pipeline as p

    docs = [
        (1, unlike("a")), (1, unlike("a")),  # a row appended twice
        (2, unlike("b")), (3, unlike("b")), (3, unlike("c")),  # 3 has a copy and a text of its own
        (None, unlike("d")), (None, unlike("d")), (4, unlike("e")), (None, unlike("e")),
    ]
    out = p.exact_stage(spark, rows_of(spark, docs), "")
    pairs = sorted((r.doc_id or 0, r.text) for r in out.collect())
    assert pairs == sorted([(1, unlike("a")), (2, unlike("b")), (3, unlike("c")), (0, unlike("d")), (4, unlike("e"))])
    near = [(7, unlike("a") + " z"), (5, unlike("a")), (5, unlike("b")), (8, unlike("c")), (None, unlike("c") + " z"), (None, unlike("d")), (None, unlike("d") + " z")]
    left = [(r.doc_id, r.text) for r in p.near_stage(spark, rows_of(spark, near), "").collect()]
    assert sorted((i or 0, t) for i, t in left if i) == sorted([(5, unlike("a")), (5, unlike("b")), (8, unlike("c"))])
    assert [t.split(" z")[0] for i, t in left if i is None] == [unlike("d")]


def test_pipeline_budget_holds_without_ids(spark):
    import corpus_pipeline as p

    docs = rows_of(spark, [(None, unlike(k)) for k in range(100)])
    assert p.mixing_stage(spark, docs, "").count() == 90


def test_pipeline_keeps_a_copy_of_everything_repeated(spark):
    import corpus_pipeline as p

    docs = rows_of(spark, [(k, unlike(k)) for k in range(40)])
    once = p.near_stage(spark, p.exact_stage(spark, docs, ""), "")
    twice = p.near_stage(spark, p.exact_stage(spark, docs.unionByName(docs), ""), "")
    assert sorted(r.doc_id for r in twice.collect()) == sorted(r.doc_id for r in once.collect()) == list(range(40))


def test_pipeline_keeps_texts_when_no_row_names_a_language(spark):
    import corpus_pipeline as p

    texts = ["Some words", "été", "слово", "123 ...", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("src0-a"), "n_chars": F.lit(1).cast("bigint")})
    assert sorted(r.doc_id for r in p.language_stage(spark, docs, "").collect()) == [0, 1, 2]
