"""Queries and their SQL on odd inputs, where the given tables may not tell them apart."""

from collections import Counter

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from sitelens.plans.catalog_pages import ORACLES, QUERIES


def differences(spark, folder, name, **tables):
    """Rows that only the query gives and rows that only its SQL gives."""
    db = duckdb.connect()
    for t, rows in tables.items():
        path = f"{folder}/{t}.parquet"
        pq.write_table(pa.table(rows), path)
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    found = QUERIES[name](spark, f"file://{folder}")
    expected = db.sql(f"SELECT {', '.join(found.columns)} FROM ({ORACLES[name]})").fetchall()
    ours, theirs = Counter(tuple(r) for r in found.collect()), Counter(expected)
    assert expected
    return ours - theirs, theirs - ours


def documents(texts):
    n = len(texts)
    return {"doc_id": pa.array(range(n), pa.int64()), "text": pa.array(texts, pa.string()), "lang": ["en"] * n, "source": [f"s{i % 2}" for i in range(n)], "n_chars": pa.array([len(t or "") for t in texts], pa.int64())}


LONG, SHORT = "long " * 26 + ". ", "Short one. "
ODD_TEXTS = [
    None, "", " 　", "a.\x0bb. c", "a. b! c? d", "x\x01y. z\x01 w.", "\n\r\n\r\n\n", "a\r\n\r\nb\n\nc", "a\x1cb.\x1cc", "a.\x85b",
    LONG * 23 + SHORT * 57, LONG * 51 + SHORT * 29, LONG * 7 + SHORT * 73, "spam " * 120,
]


def test_readability_on_odd_texts(spark, tmp_path):
    """Null texts, white space by Unicode, and 23 / 80 = 28.75 % to one place, half to even."""
    for name in ("text_readability", "text_content_summary"):
        assert differences(spark, tmp_path, name, documents=documents(ODD_TEXTS)) == (Counter(), Counter())


def test_text_rules_on_odd_texts(spark, tmp_path):
    assert differences(spark, tmp_path, "text_rules", documents=documents(ODD_TEXTS)) == (Counter(), Counter())


def test_first_snapshot_of_equal_ids(spark, tmp_path):
    """Lines may repeat a key; whichever is read first, the lowest flag counts."""
    flags = [f for _ in range(20) for f in ("R", "N", "A")]
    for order in (flags, flags[::-1]):
        n = len(order)
        lines = {"l_partkey": pa.array([i // 3 for i in range(n)], pa.int64()), "l_orderkey": pa.array([7] * n, pa.int64()), "l_linenumber": pa.array([1] * n, pa.int32()), "l_returnflag": order}
        assert differences(spark, tmp_path, "evidence_first_snapshot", part={"p_partkey": pa.array(range(25), pa.int64())}, lineitem=lines) == (Counter(), Counter())


def pages(bodies):
    n = len(bodies)
    html = [f'<!DOCTYPE html><html lang="en"><head><title>{b}</title></head>\n<body><h1>{b}</h1>\n<p>More <b>{b}</b> text.</p></body></html>' for b in bodies]
    return {"page_id": pa.array(range(n), pa.int64()), "url": [f"https://shop.example/{i}" for i in range(n)], "html": html}


ODD_TITLES = [
    "Plain", "cut &amp", "cut &am", "&quot;quoted&quot cut &quo", "&amp;quot; &amp;amp", "1 &lt; 2 &gt 1", "it&#x27;s &copy &middot;", "no-break\u00a0space\x0band\x1fmore",
    "nineteen letters a&amp", "sixty-five letters " + "x" * 45 + "&amp",
]


def test_page_titles_with_references(spark, tmp_path):
    assert differences(spark, tmp_path, "page_titles_extracted", pages=pages(ODD_TITLES)) == (Counter(), Counter())


def test_page_extraction_with_references(spark, tmp_path):
    assert differences(spark, tmp_path, "page_extraction", pages=pages([*ODD_TITLES, ""])) == (Counter(), Counter())


def test_rules_on_extracted_pages(spark, tmp_path):
    """Lengths of titles with references, and shares of long sentences that lie between two tenths."""
    body = lambda n: LONG * n + SHORT * (80 - n)
    table = pages(ODD_TITLES)
    table["html"] += [f"<html><head><title>Shares of long sentences</title></head><body><h1>t</h1>{body(n)}</body></html>" for n in (23, 24, 25)]
    table["page_id"], table["url"] = pa.array(range(13), pa.int64()), [f"https://shop.example/{i}" for i in range(13)]
    assert differences(spark, tmp_path, "site_rules_extracted", pages=table) == (Counter(), Counter())


def test_meta_data_of_pages_made_of_parts(spark, tmp_path):
    """More parts than a task makes pages of, in one file."""
    n = 6_000
    part = {"p_partkey": pa.array(range(n), pa.int64()), "p_name": [f"part {i}" for i in range(n)], "p_brand": ["b"] * n, "p_type": ["t"] * n, "p_size": pa.array([1] * n, pa.int32()), "p_retailprice": [1.0] * n}
    assert differences(spark, tmp_path, "page_meta_data", part=part) == (Counter(), Counter())
    assert QUERIES["page_meta_data"](spark, f"file://{tmp_path}").select("page_id").withColumn("t", F.spark_partition_id()).select("t").distinct().count() > 1


def test_similarity_on_odd_texts(spark, tmp_path):
    """Null, empty and short texts beside one another, and such as share some triples."""
    texts = [None, None, "", None, "a", "", "", "a b", "b a", "A, b!", "a b c d", "a b c e", None, "a b c a b c a b", LONG, SHORT * 3, SHORT * 2]
    assert differences(spark, tmp_path, "text_similarity", documents=documents(texts)) == (Counter(), Counter())
