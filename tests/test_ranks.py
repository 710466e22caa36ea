"""Positions in groups of any size, pages of them, and topics that hold one another."""

import random

import pytest
from pyspark.sql import functions as F

from sitelens.operators.ranks import ranked
from sitelens.plans import competitors
from sitelens.plans.audit import page_browser, pages_after
from sitelens.plans.competitors import topic_matches

RNG = random.Random(6)
ROWS = [(RNG.choice([1, 1, 1, 1, 2, None]), f"u{RNG.randint(0, 40)}", i) for i in range(600)]


@pytest.fixture
def pages(spark):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else few rows end in one partition
    yield spark.createDataFrame(ROWS, "crawl_id int, url string, page_id int").repartition(5)
    spark.conf.set("spark.sql.adaptive.enabled", before)


def expected():
    found = {}
    for c, u, i in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        found.setdefault(c, []).append(i)
    return found


def test_positions_of_every_row(pages):
    out = ranked(pages, "crawl_id", ["url", "page_id"])
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.crawl_id, r.page_id): r["rank"] for r in out.collect()} == {(c, i): k for c, ids in expected().items() for k, i in enumerate(ids, 1)}
    assert out.columns == [*pages.columns, "rank"]
    down = ranked(pages, "crawl_id", [F.desc("url"), F.desc("page_id")]).filter("rank = 1 and crawl_id is not null").collect()
    assert {(r.crawl_id, r.page_id) for r in down} == {(c, ids[-1]) for c, ids in expected().items() if c is not None}
    assert ranked(pages.limit(0), "crawl_id", ["url"]).count() == 0


def test_pages_of_a_crawl(pages):
    whole = expected()
    for page, size in ((1, 20), (3, 50), (40, 10), (1, 1_000)):
        found = page_browser(pages, page, size).collect()
        size = min(size, 200)
        for c in (1, 2):
            own = sorted((r.n, r.page_id) for r in found if r.crawl_id == c)
            assert own == list(enumerate(whole[c], 1))[(page - 1) * size : page * size]
            assert {r.total for r in found if r.crawl_id == c} <= {len(whole[c])}
    seen, last = [], (None, None)
    while rows := pages_after(pages, 1, *last, size=70).collect():
        seen += [r.page_id for r in rows]
        last = rows[-1].url, rows[-1].page_id
    assert seen == whole[1]


def test_topics_that_hold_one_another(spark):
    alphabet = ["the", "best", "tea", "cup", "a", "of", "x", "tea cup"]
    topics = lambda n: [" ".join(RNG.choices(alphabet, k=RNG.randint(1, 4))) for _ in range(n)]
    own, asked = [t for t in topics(60) if len(t) > 2], [t for t in topics(80) if len(t) > 2]
    frame = lambda rows: spark.createDataFrame([(t,) for t in rows], "topic string")
    found = {(r.topic, r.own) for r in topic_matches(frame(own), frame(asked)).collect()}
    assert found == {(a, o) for o in own for a in asked if a in o or o in a}


def test_titles_that_begin_alike_meet_few_others(spark, monkeypatch):
    """Half of the topics share their beginning and ending: looked-up rows stay in proportion to the topics."""
    made = {}
    real = competitors.Scratch.save
    monkeypatch.setattr(competitors.Scratch, "save", lambda self, df, name: made.setdefault(name, real(self, df, name)))
    word = lambda: "".join(RNG.choices("abcdefghijklmnopqrstuvwxyz", k=12))
    own, asked = [[f"the best of {word()} shop" if i % 2 else word() for i in range(2_000)] for _ in range(2)]
    frame = lambda rows: spark.createDataFrame([(t,) for t in rows], "topic string")
    assert topic_matches(frame(own + asked[:30]), frame(asked)).count() == 30
    looked_up = made["rarest"].join(made["grams"], "g").count()
    assert looked_up < 5 * 4_000
