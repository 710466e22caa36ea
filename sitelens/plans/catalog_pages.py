"""Registered queries over html: what extraction finds in the given pages, and in pages whose markup is made of the parts table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.extract import META, extract_pages, page_assets, page_meta
from ..operators.rules import Rule, evaluate_rules, page_rules
from ..sources import ingest
from ..sources.tables import read_table
from . import catalog_records, visibility
from .durable import Scratch, fresh_path
from .expected import EXPECTED, markup_text
from .registry import ORACLES, QUERIES, plain, query
from .views import ctes, rule_pages, view

__all__ = ["ORACLES", "QUERIES", "catalog_records"]

#: Titles, headings and body text of the given pages, by regular expressions.
_EXTRACTED = rf"""b AS (
  SELECT page_id, url, regexp_replace(html, '<!--.*?-->', '', 'gs') AS h FROM pages
), x AS (
  SELECT page_id, url, h, {markup_text("regexp_extract(h, '<title>(.*?)</title>', 1, 's')")} AS title,
         {markup_text("regexp_extract(h, '<h1>(.*?)</h1>', 1, 's')")} AS h1, CASE WHEN h LIKE '%<html lang="%' THEN regexp_extract(h, '<html lang="([^"]*)"', 1) END AS language,
         {markup_text("regexp_extract(h, '<body[^>]*>(.*)$', 1, 's')")} AS text,
         len(list_filter(regexp_extract_all(h, '<h[1-6]>(.*?)</h[1-6]>', 1, 's'), lambda t: {markup_text("t")} <> '')) AS headings, len(list_filter(regexp_extract_all(h, '<h1>(.*?)</h1>', 1, 's'), lambda t: {markup_text("t")} <> '')) AS n_h1, len(regexp_extract_all(h, '<a href=')) AS links
  FROM b
)"""


@query(
    "page_extraction",
    rf"""WITH {_EXTRACTED} SELECT page_id, nullif(title, '') AS title, nullif(h1, '') AS h1, language, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+')) AS word_count, headings, links, 0 AS assets, md5(text) AS text_md5, NULL::VARCHAR AS error FROM x""",
)
def page_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_pages(read_table(spark, sf_dir, "pages"))
    sizes = [F.size(c).cast("bigint").alias(c) for c in ("headings", "links", "assets")]
    return found.select("page_id", "title", "h1", "language", F.col("word_count").cast("bigint").alias("word_count"), *sizes, F.md5("text").alias("text_md5"), "error")


#: Rules on the given pages, which hold titles, headings and text but no other evidence; those left out read what a fetch tells.
_ON_MARKUP = {
    **dict.fromkeys(("CANONICAL_INVALID", "CANONICAL_MISMATCH", "NOINDEX", "HEADING_STRUCTURE", "ALT_MISSING", "META_DESCRIPTION_LENGTH", "MIXED_CONTENT_ASSETS", "EXCESSIVE_RESOURCES", "SCHEMA_SYNTAX_INVALID", "SCHEMA_MISSING_REQUIRED"), "false"),
    **dict.fromkeys(("HREFLANG_NO_SELF_REFERENCE", "HREFLANG_INVALID_CODE", "RENDER_BLOCKING_RESOURCES", "IMAGE_DIMENSIONS_MISSING"), "false"),
    **dict.fromkeys(("META_DESCRIPTION_MISSING", "CANONICAL_MISSING"), "true"),
    **dict.fromkeys(("SECURITY_HEADERS_MISSING", "CACHE_CONTROL_MISSING"), "status = 200"),
    "HSTS_MISSING": "url LIKE 'https://%' AND status = 200",
    "STRUCTURED_DATA_ABSENT": "ok",
    "KEYWORD_STUFFING": "word_count >= 100 AND stuffed",
    "CONTENT_LONG_SENTENCES": "word_count >= 100 AND sentences >= 4 AND long_share > 30",
}
_JUDGED = " UNION ALL ".join(
    f"SELECT crawl_id, page_id, '{code}' AS code, coalesce({_ON_MARKUP.get(code, condition)}, false) AS triggered, {severity} AS severity, '{category}' AS category FROM p"
    for code, (condition, severity, category) in EXPECTED.items()
)


@query(
    "site_rules_extracted",
    rf"""WITH {ctes("v_page")}, {_EXTRACTED}, documents AS (SELECT page_id AS doc_id, text, '' AS source FROM x), {catalog_records.READS}, {catalog_records.TERMS},
st AS (SELECT doc_id AS page_id, bool_or(stuffing) AS s FROM terms GROUP BY doc_id), p AS (
  SELECT v.* EXCLUDE (title, h1, word_count, n_h1), x.title, x.n_h1, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+')) AS word_count, coalesce(s, false) AS stuffed, r.sentences, r.long_share,
         status = 200 AND x_robots IS NULL AS ok
  FROM v_page v JOIN x USING (page_id) JOIN (SELECT doc_id AS page_id, sentences, long_share FROM reads) r USING (page_id) LEFT JOIN st USING (page_id)
) {_JUDGED}""",
)
def site_rules_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules on pages as they were extracted from html."""
    return evaluate_rules(catalog_records.extracted_evidence(spark, sf_dir)).drop("evidence")


@query(
    "page_asset_list",
    f"""WITH {ctes("v_markup")}, a(k, type, url, alt, external, mixed, width, height, is_async, is_defer, loading, media, title) AS (
  VALUES (1, 'Image', 'https://shop.example/i.png', '*', false, false, '10', '5', false, false, 'lazy', NULL, NULL), (1, 'Image', 'http://img.example/b.png', NULL, true, true, NULL, NULL, false, false, NULL, NULL, NULL),
  (2, 'Iframe', 'https://player.example/1', 'Film', true, false, NULL, NULL, false, false, NULL, NULL, 'Film'), (3, 'Stylesheet', 'http://cdn.example/s.css', NULL, true, true, NULL, NULL, false, false, NULL, 'print', NULL),
  (4, 'Script', 'https://shop.example/a.js', NULL, false, false, NULL, NULL, true, false, NULL, NULL, NULL), (4, 'Script', 'https://cdn.example/b.js', NULL, true, false, NULL, NULL, false, false, NULL, NULL, NULL)
)
SELECT page_id, a.type, a.url, CASE alt WHEN '*' THEN p_brand ELSE alt END AS alt, external, mixed, width, height, is_async, is_defer, loading, media, a.title
FROM part JOIN v_markup ON page_id = p_partkey JOIN a ON (k = 1 AND page_id % 5 = 3) OR (k = 2 AND page_id % 11 = 4) OR (k = 3 AND page_id % 2 = 0) OR (k = 4 AND page_id % 8 < 3)""",
)
def page_asset_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_assets(extract_pages(view(spark, sf_dir, "v_markup"), wanted=("assets",)))


@query(
    "page_meta_data",
    """SELECT p_partkey AS page_id,
  CASE p_partkey % 6 WHEN 0 THEN '{"@type":"FAQPage"}' WHEN 1 THEN '{"@type":"Organization","name":"x"}|{"@type":["Article","NewsArticle"],"author":"a"}' WHEN 2 THEN '{'
    WHEN 3 THEN '{"@graph":[{"@type":"Product","name":"n"},{"@graph":[{"@type":"QAPage","dateModified":"2024-01-01"}]}]}' ELSE '' END AS blocks,
  CASE WHEN p_partkey % 5 < 2 THEN 'de https://shop.example/de|es https://es.example/' ELSE '' END AS alternates,
  CASE WHEN p_partkey % 3 = 0 THEN '{"og:title":"' || p_name || '"}' ELSE '{}' END AS open_graph, CASE WHEN p_partkey % 4 = 1 THEN '{"Twitter:card":"summary"}' ELSE '{}' END AS twitter
FROM part""",
)
def page_meta_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = page_meta(extract_pages(view(spark, sf_dir, "v_markup"), wanted=META))
    alternates = F.transform("hreflang", lambda x: F.concat_ws(" ", x["language"], x["target"]))
    return found.select("page_id", F.array_join("json_ld", "|").alias("blocks"), F.array_join(alternates, "|").alias("alternates"), F.to_json("open_graph").alias("open_graph"), F.to_json("twitter").alias("twitter"))


@query(
    "site_visibility",
    r"""WITH t AS (
  SELECT p_partkey AS id, len(regexp_extract_all(p_name || CASE p_partkey % 9 WHEN 0 THEN 'Is it large?' WHEN 1 THEN 'OneTwo' WHEN 2 THEN ' How it worksEnd' ELSE '' END
    || p_brand || ' indeed ' || repeat('w ', CAST(p_partkey * 37 % 1400 AS INT)), '[\p{L}\p{N}]+')) AS words FROM part
), s AS (
  SELECT id % 4 AS crawl_id, count(*) AS pages, count(*) FILTER (id % 9 IN (0, 2)) AS n_question, count(*) FILTER (id % 6 IN (0, 3)) AS n_faq, count(*) FILTER (id % 6 IN (0, 1, 3)) AS n_schema,
         count(*) FILTER (id % 6 IN (1, 3)) AS n_entity, count(*) FILTER (id % 6 IN (1, 3)) AS n_author, count(*) FILTER (id % 7 <> 0) AS n_canonical, count(*) FILTER (words BETWEEN 150 AND 1200) AS n_concise,
         count(*) FILTER (id % 9 IN (1, 2)) AS n_structure, count(*) FILTER (id % 6 <> 2) AS n_evaluable FROM t GROUP BY ALL
), r AS (
  SELECT *, CAST(30 * n_question + 20 * n_faq + 20 * n_concise + 30 * n_structure AS DECIMAL(18,8)) / pages AS a, CAST(30 * n_schema + 30 * n_entity + 20 * n_canonical + 20 * n_author AS DECIMAL(18,8)) / pages AS c,
         CAST(100 * n_concise AS DECIMAL(18,8)) / pages AS x FROM s
), o AS (SELECT *, CAST(round_even(a, 1) AS DECIMAL(6,1)) AS answer, CAST(round_even(c, 1) AS DECIMAL(6,1)) AS citation, CAST(round_even(x, 1) AS DECIMAL(6,1)) AS accessibility FROM r)
SELECT * EXCLUDE (a, c, x, answer, citation, accessibility), CAST(answer AS DOUBLE) AS answer, CAST(citation AS DOUBLE) AS citation, CAST(accessibility AS DOUBLE) AS accessibility,
       CAST(round_even(CAST(0.4 * 70 + 0.25 * answer + 0.25 * citation + 0.1 * accessibility AS DECIMAL(10,4)), 1) AS DOUBLE) AS visibility FROM o""",
)
def site_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals and scores of sites whose robots files were worth 70; pages are read once, not for each use of the signals."""
    signals = visibility.ai_page_signals(extract_pages(view(spark, sf_dir, "v_markup")).withColumn("crawl_id", F.col("page_id") % 4))
    signals = Scratch(spark, "visibility").save(signals, "signals")
    known = signals.select("crawl_id", F.lit("70.0").cast("decimal(5,1)").alias("crawlability"))
    return plain(signals.join(visibility.ai_scores(signals, known).drop("crawlability"), "crawl_id"))


_ENTRY = """SELECT url AS location, page_id, CASE page_id % 3 WHEN 0 THEN concat('2024-01-', lpad(CAST(1 + page_id % 28 AS STRING), 2, '0')) WHEN 1 THEN 'yesterday' END AS lastmod,
  CASE page_id % 4 WHEN 0 THEN 'Weekly' WHEN 1 THEN 'daily' END AS changefreq, CASE WHEN page_id % 5 = 0 THEN '7' ELSE concat('0.', CAST(page_id % 10 AS STRING)) END AS priority"""


@query(
    "sitemap_entries",
    f"""WITH e AS ({_ENTRY} FROM pages) SELECT location, CAST(max(try_cast(lastmod AS DATE)) AS VARCHAR) AS lastmod, min(lower(changefreq)) AS changefreq,
  CAST(max(CASE WHEN CAST(priority AS DOUBLE) <= 1 THEN CAST(priority AS DOUBLE) END) AS DOUBLE) AS priority FROM e WHERE length(location) <= 2048 GROUP BY location""",
)
def sitemap_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sitemap of all given pages and some addresses that don't count, written as XML and read again."""
    rows = spark.sql(_ENTRY + " FROM {pages}", pages=read_table(spark, sf_dir, "pages"))
    refused = rows.select(F.concat(F.lit("ftp://x/"), F.col("page_id").cast("string")).alias("location"), "page_id", "lastmod", "changefreq", "priority")
    path = fresh_path(spark, "sitemap")
    entries = rows.unionByName(refused).select(F.concat(F.lit(" "), "location").alias("loc"), "lastmod", "changefreq", "priority")
    entries.write.format("xml").option("rootTag", "urlset").option("rowTag", "url").save(path)
    found = ingest.sitemap_urls(spark, [path], max_urls=1 << 30)
    return plain(found.withColumn("lastmod", F.date_format("lastmod", "yyyy-MM-dd")))


@query(
    "site_own_rule",
    f"""WITH {ctes("v_page")} SELECT crawl_id, page_id, 'TITLE_SHOUTS' AS code, title = upper(title) AS triggered, CASE WHEN page_id % 2 = 0 THEN 'High' ELSE 'Low' END AS severity, 'OnPage' AS category, title AS actual, 'Small letters' AS expected FROM v_page
UNION ALL SELECT crawl_id, page_id, 'LOW_WORD_COUNT', word_count < 100, 'Low', 'Content', CAST(word_count AS VARCHAR), '100 words or more' FROM v_page""",
)
def site_own_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule of one's own beside one of the given rules with another threshold."""
    own = Rule("TITLE_SHOUTS", "OnPage", lambda: F.when(F.col("page_id") % 2 == 0, "High").otherwise("Low"), lambda: F.col("title") == F.upper("title"), "title", lambda: F.col("title"), "Small letters")
    low = [r for r in page_rules(low_words=100) if r.code == "LOW_WORD_COUNT"]
    return evaluate_rules(rule_pages(spark, sf_dir), [own, *low]).select("crawl_id", "page_id", "code", "triggered", "severity", "category", "evidence.actual", "evidence.expected")
