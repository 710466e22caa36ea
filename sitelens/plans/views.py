"""Evidence views over the given tables, each one SQL text that Spark and other engines accept alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table

#: Name: (tables it reads, SQL).  Figures that the tables lack are formulas over their ids.
VIEWS: dict[str, tuple[list[str], str]] = {
    "v_page": (
        ["pages"],
        """SELECT page_id, page_id % 4 AS crawl_id, page_id % 4 AS project_id, url,
  regexp_extract(html, '<title>(.*?)</title>', 1) AS title, regexp_extract(html, '<h1>(.*?)</h1>', 1) AS h1,
  CASE page_id % 20 WHEN 3 THEN 404 WHEN 7 THEN 301 WHEN 11 THEN 500 ELSE 200 END AS status,
  page_id * 37 % 3000 AS response_ms, page_id % 6 AS depth, page_id * 29 % 700 AS word_count, page_id % 4 AS missing_alt, page_id % 5 AS hops,
  CASE WHEN page_id % 9 = 0 THEN NULL ELSE repeat('d', CAST(page_id * 13 % 220 AS INT)) END AS meta_description,
  CASE page_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '/relative' WHEN 2 THEN concat('https://other.example/', CAST(page_id AS STRING)) ELSE url END AS canonical,
  CASE WHEN page_id % 10 = 4 THEN 'NoIndex, follow' ELSE 'index' END AS robots_meta, CASE WHEN page_id % 13 = 5 THEN 'noindex' END AS x_robots,
  CASE WHEN page_id % 17 = 6 THEN ' ' ELSE 'text/html' END AS content_type,
  page_id % 3 AS n_h1, page_id % 8 AS ld_kind, page_id % 6 AS lang_kind, page_id % 16 AS header_kind, page_id % 30 AS n_scripts, page_id % 5 AS n_images
FROM {pages}""",
    ),
    "v_markup": (
        ["part"],
        """SELECT p_partkey AS page_id, p_partkey % 4 AS crawl_id, concat('https://shop.example/p/', CAST(p_partkey AS STRING)) AS url,
  concat('<!DOCTYPE html><html lang="en"><head><title> ', p_name, ' </title>',
    CASE WHEN p_partkey % 3 = 0 THEN concat('<meta property="og:title" content="', p_name, '"><meta property="OG:Title" content="later"><meta property="og:image">') ELSE '' END,
    CASE WHEN p_partkey % 4 = 1 THEN '<META NAME="Twitter:card" CONTENT="summary">' ELSE '' END,
    CASE WHEN p_partkey % 5 < 2 THEN '<link rel="alternate" hreflang="de" href="/de"><link rel="Alternate" hreflang="de" href="https://shop.example/de"><link rel="alternate" hreflang="fr" href="ftp://x/"><link hreflang="es" rel="x ALTERNATE" href="//es.example/"> ' ELSE '' END,
    CASE p_partkey % 6 WHEN 0 THEN '<script type="application/ld+json">{{"@type":"FAQPage"}}</script>'
      WHEN 1 THEN '<script type="Application/LD+json"> {{"@type":"Organization","name":"x"}} </script><script type="application/ld+json">{{"@type":["Article","NewsArticle"],"author":"a"}}</script>'
      WHEN 2 THEN '<script type="application/ld+json">{{</script>'
      WHEN 3 THEN '<script type="application/ld+json">{{"@graph":[{{"@type":"Product","name":"n"}},{{"@graph":[{{"@type":"QAPage","dateModified":"2024-01-01"}}]}}]}}</script><script type="application/ld+json"> </script>' ELSE '' END,
    CASE WHEN p_partkey % 7 <> 0 THEN '<link rel="canonical" href="/canonical">' ELSE '' END,
    CASE WHEN p_partkey % 2 = 0 THEN '<link rel="StyleSheet" href="http://cdn.example/s.css" media="print">' ELSE '' END,
    CASE WHEN p_partkey % 8 < 3 THEN '<script src=" /a.js " async></script><script src="//cdn.example/b.js" type="module"></script>' ELSE '' END,
    '</head><body><h1>', p_name, '</h1>',
    CASE p_partkey % 9 WHEN 0 THEN '<h2>Is it <i>large</i>?</h2>' WHEN 1 THEN '<h2>One</h2><h3>Two</h3>' WHEN 2 THEN '<h2> </h2><h2>How it works</h2><h6>End</h6>' ELSE '' END,
    '<p>', p_brand, ' in<b>de</b>ed ', repeat('<b>w</b> ', CAST(p_partkey * 37 % 1400 AS INT)), '</p>',
    CASE WHEN p_partkey % 5 = 3 THEN concat('<img src="/i.png" alt=" ', p_brand, ' " width="10" height="5" loading="lazy"><img src="http://img.example/b.png" alt=" ">') ELSE '' END,
    CASE WHEN p_partkey % 11 = 4 THEN '<iframe src="https://player.example/1" title="Film"></iframe><iframe src="javascript:x"></iframe>' ELSE '' END,
    '</body></html>') AS html
FROM {part}""",
    ),
    "v_link": (
        ["lineitem"],
        """SELECT l_partkey AS source_id, (l_suppkey - 1) * 20 + l_orderkey * 3 % 20 + 1 AS target_id,
  CASE l_orderkey % 6 WHEN 0 THEN 'Read more' WHEN 1 THEN ' here ' WHEN 2 THEN 'HERE' WHEN 3 THEN concat('Part ', CAST(l_suppkey % 20 AS STRING)) WHEN 4 THEN '' ELSE 'Catalogue' END AS anchor
FROM {lineitem}""",
    ),
    "v_node": (["part"], "SELECT p_partkey AS page_id, p_partkey % 50 = 0 AS is_root, p_partkey % 3 <> 0 AS in_seeds FROM {part}"),
    "v_metric": (
        ["lineitem"],
        """SELECT l_partkey % 5 AS project_id, l_partkey AS keyword_id, CAST(l_shipdate AS DATE) AS date, CAST(l_quantity AS INT) AS impressions,
  CAST(floor(l_quantity * l_discount) AS INT) AS clicks, CAST(1 + round(l_tax * 200) AS INT) AS position, concat('/p/', CAST(l_suppkey % 4 AS STRING)) AS page_url,
  CASE WHEN l_linenumber % 2 = 0 THEN 'api' ELSE 'import' END AS source
FROM {lineitem}""",
    ),
    "v_keyword": (["part"], "SELECT p_partkey % 5 AS project_id, p_partkey AS keyword_id, p_name AS phrase, p_partkey % 2 = 0 AS is_tracked FROM {part}"),
    "v_serp": (
        ["supplier"],
        """SELECT s_nationkey AS keyword_id, concat('https://www.', lower(replace(s_name, '#', '-')), '.example/Page/') AS url,
  CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS BIGINT) AS old_rank,
  CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey * 7919 % 1009, s_suppkey) AS BIGINT) AS new_rank,
  s_suppkey % 10 <> 3 AS in_old, s_suppkey % 10 <> 7 AS in_new
FROM {supplier}""",
    ),
    "v_rival": (
        ["orders", "customer"],
        """SELECT c.c_mktsegment AS competitor_id, concat(c.c_mktsegment, '-', CAST(o.o_orderkey % 3 AS STRING)) AS crawl_id, o.o_orderkey % 3 AS created_at, CASE o.o_orderstatus WHEN 'F' THEN 404 ELSE 200 END AS status,
  concat('/o/', CAST(o.o_orderkey AS STRING)) AS url, CASE WHEN o.o_orderkey % 11 = 0 THEN '  ' ELSE concat(replace(o.o_orderpriority, '-', ' '), ' order ', CAST(o.o_custkey % 97 AS STRING), ' | shop') END AS title,
  o.o_orderkey % 900 AS word_count, o.o_orderkey * 31 % 2000 AS response_ms, o.o_orderkey % 5 <> 0 AS is_indexable, o.o_orderkey % 4 <> 1 AS has_description, o.o_orderkey % 40 AS internal_links
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey""",
    ),
    "v_usage": (
        ["orders", "customer"],
        """SELECT c.c_nationkey AS owner_id, c.c_custkey AS project_id, CASE WHEN c.c_custkey % 10 = 3 THEN 'Archived' ELSE 'Active' END AS project_status, o.o_orderkey AS page_id, o.o_orderdate AS started_at
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey""",
    ),
}


#: Views whose rows are far larger than those they are made of, and the key and number of rows that a task makes.
SPREAD = {"v_markup": ("p_partkey", 5_000)}


def spread(rows: DataFrame, key: str, each: int) -> DataFrame:
    """Small rows that grow large later, dealt over tasks by their number; their files may be too small to be split."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // each)), key)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables, sql = VIEWS[name]
    given = {t: read_table(spark, sf_dir, t) for t in tables}
    return spark.sql(sql, **{t: spread(rows, *SPREAD[name]) if name in SPREAD else rows for t, rows in given.items()})


def ctes(*names: str) -> str:
    """The views as common table expressions over tables of their own names."""
    return ", ".join(f"{n} AS ({VIEWS[n][1].format(**{t: t for t in VIEWS[n][0]})})" for n in names)


def _repeat(n: Column, item: Column) -> Column:
    return F.array_repeat(item, n.cast("int"))


def rule_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``v_page`` as page evidence: the counts and kinds become headings, assets, headers and blocks."""
    p = view(spark, sf_dir, "v_page")
    heading = lambda level: F.struct(F.lit(level).cast("int").alias("level"), F.lit("t").alias("text"))
    none = F.array().cast("array<struct<level:int,text:string>>")
    asset = lambda kind, mixed, width, is_async: F.struct(
        F.lit(kind).alias("type"), F.lit("u").alias("url"), F.lit(mixed).alias("mixed"), width.alias("width"), width.alias("height"), is_async.alias("is_async"), F.lit(False).alias("is_defer")
    )
    size = F.when(F.col("page_id") % 3 != 1, "10")
    even_sync = (F.col("page_id") % 2) != 0
    blocks = F.array(
        *[F.lit(b) for b in ("", "{", '{"name":"x"}', '{"@type":"NewsArticle","headline":"h"}', '{"@type":"Product","name":"n"}', '{"@type":"BreadcrumbList","itemListElement":[]}', '{"@type":"Organization"}', '{"@graph":[],"@type":"FAQPage"}')]
    )
    alternate = lambda lang, target: F.array(F.struct(F.lit(lang).alias("language"), target.alias("target")))
    no_alternate = F.array().cast("array<struct<language:string,target:string>>")
    kind = F.col("header_kind")
    header = lambda name, bit: F.when((F.floor(kind / bit) % 2) == 1, F.array(F.struct(F.lit(name).alias("k"), F.array(F.lit("v")).alias("v")))).otherwise(F.array().cast("array<struct<k:string,v:array<string>>>"))
    entries = F.concat(header("Strict-Transport-Security", 1), header("x-content-type-options", 2), header("X-Frame-Options", 4), header("Cache-Control", 8))
    return p.select(
        "*",
        F.lit(True).alias("has_snapshot"),
        F.concat(_repeat(F.col("n_h1"), heading(1)), F.array(heading(2)), F.when(F.col("page_id") % 5 == 0, F.array(heading(4))).otherwise(none)).alias("headings"),
        F.concat(
            _repeat(F.col("n_scripts"), asset("Script", False, F.lit(None).cast("string"), even_sync)),
            _repeat(F.col("n_images"), asset("Image", False, size, F.lit(False))),
            _repeat(F.when(F.col("page_id") % 4 == 2, 1).otherwise(0), asset("Iframe", True, F.lit(None).cast("string"), F.lit(False))),
        ).alias("assets"),
        F.when(F.col("ld_kind") == 0, F.array().cast("array<string>")).otherwise(F.array(F.element_at(blocks, (F.col("ld_kind") + 1).cast("int")))).alias("json_ld"),
        F.when(F.col("lang_kind") == 1, alternate("en", F.lit("https://elsewhere.example/")))
        .when(F.col("lang_kind") == 2, F.concat(alternate("فارسی", F.col("url")), alternate("fa-IR", F.lit("https://elsewhere.example/"))))
        .when(F.col("lang_kind") == 3, alternate("x-default", F.col("url"))).otherwise(no_alternate).alias("hreflang"),
        F.map_from_entries(entries).alias("headers"),
        _repeat(F.col("hops"), F.lit("h")).alias("redirects"),
        ((F.col("status") == 200) & (F.col("page_id") % 10 != 4) & (F.col("page_id") % 13 != 5)).alias("is_indexable"),
        F.lit(None).cast("string").alias("text"),
    )
