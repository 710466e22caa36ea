"""Registered queries over the given tables, each with its expected result in SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.extract import extract_pages, page_links
from ..functions.text import readability, top_terms
from ..functions.urls import normalize_url
from ..operators.duplicates import duplicate_clusters
from ..operators.links import duplicate_titles, generic_anchor_issues, graph_issues, internal_authority, link_graph, link_summary, top_anchors
from ..operators.robots import discover_urls
from ..operators.rules import CATEGORIES, evaluate_rules
from ..operators.scoring import column_name, issues, recommendations, scores
from ..plans.durable import fresh_path
from ..sources import ingest
from ..sources.tables import read_table
from ..streaming import streams
from . import accounts, audit, competitors, keywords, snapshots
from .expected import rule_ctes
from .registry import ORACLES, QUERIES, plain, query
from .views import ctes, rule_pages, view

# Sites: rules, scores, recommendations


@query("site_rules", f"WITH {rule_ctes()} SELECT crawl_id, page_id, code, triggered, severity, category FROM results")
def site_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate_rules(rule_pages(spark, sf_dir)).drop("evidence")


_PER_CODE = """codes AS (
  SELECT crawl_id, category, code, count(*) AS total, count(*) FILTER (triggered) AS fired,
         max(CASE WHEN triggered THEN CASE severity WHEN 'Notice' THEN 2 WHEN 'Low' THEN 7 WHEN 'Medium' THEN 15 WHEN 'High' THEN 25 ELSE 40 END END) AS most
  FROM results GROUP BY ALL
), cats AS (
  SELECT crawl_id, category, round(greatest(0, 100 - sum(CAST(coalesce(most * CAST(fired AS DECIMAL(18,0)) / total, 0) AS DECIMAL(18,8)))), 1) AS s FROM codes GROUP BY ALL
), w(category, weight) AS (
  VALUES ('Technical', 0.20), ('Indexability', 0.15), ('OnPage', 0.15), ('Content', 0.15), ('InternalLinks', 0.10), ('StructuredData', 0.05), ('Performance', 0.10), ('International', 0.05), ('Security', 0.05)
)"""


@query(
    "site_scores",
    f"""WITH {rule_ctes()}, {_PER_CODE}
SELECT crawl_id, CAST(round(CAST(sum(CAST(s AS DECIMAL(5,1)) * CAST(weight AS DECIMAL(3,2))) / sum(CAST(weight AS DECIMAL(3,2))) AS DECIMAL(18,8)), 1) AS DOUBLE) AS overall,
  {", ".join(f"CAST(max(CASE WHEN category = '{c}' THEN s END) AS DOUBLE) AS {column_name(c)}" for c in CATEGORIES)}, count(*) < 9 AS is_partial, '1.0' AS version
FROM cats JOIN w USING (category) GROUP BY crawl_id""",
)
def site_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scores(evaluate_rules(rule_pages(spark, sf_dir)))
    return plain(found)


@query(
    "site_recommendations",
    f"""WITH {rule_ctes()}
SELECT crawl_id, page_id, code, severity, CASE severity WHEN 'High' THEN 82 WHEN 'Medium' THEN 65 WHEN 'Low' THEN 40 ELSE 20 END AS priority,
  CASE severity WHEN 'High' THEN 'high' WHEN 'Medium' THEN 'medium' ELSE 'low' END AS impact, CASE WHEN code LIKE '%CONTENT%' THEN 'medium' ELSE 'low' END AS effort, CAST(0.9 AS DOUBLE) AS confidence
FROM results WHERE triggered""",
)
def site_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recommendations(issues(evaluate_rules(rule_pages(spark, sf_dir))))
    return plain(found.select("crawl_id", "page_id", "code", "severity", "priority", "impact", "effort", "confidence"))


@query(
    "site_dashboard",
    f"""WITH {rule_ctes()}, i AS (SELECT * FROM results WHERE triggered), r AS (
  SELECT *, row_number() OVER (PARTITION BY crawl_id ORDER BY CASE severity WHEN 'High' THEN 4 WHEN 'Medium' THEN 3 WHEN 'Low' THEN 2 ELSE 1 END DESC, code, page_id) AS k FROM i
)
SELECT crawl_id, count(*) AS open_issues, count(*) FILTER (severity = 'High') AS urgent, string_agg(code, ',' ORDER BY k) FILTER (k <= 8) AS top_codes FROM r GROUP BY crawl_id""",
)
def site_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = evaluate_rules(rule_pages(spark, sf_dir))
    crawls = results.select("crawl_id").distinct().select("crawl_id", F.col("crawl_id").alias("project_id"), F.lit("Completed").alias("status"), F.lit(0).alias("created_at"))
    found = audit.dashboard(crawls, issues(results), results.select("crawl_id", F.lit(0).alias("overall")).distinct())
    return found.select("crawl_id", "open_issues", "urgent", F.array_join("top_codes", ",").alias("top_codes"))


@query(
    "site_issue_list",
    f"""WITH {rule_ctes()}
SELECT r.crawl_id, r.page_id, r.code, v.url, row_number() OVER (PARTITION BY r.crawl_id ORDER BY CASE severity WHEN 'High' THEN 4 WHEN 'Medium' THEN 3 WHEN 'Low' THEN 2 ELSE 1 END DESC, code, r.page_id) AS rank
FROM results r JOIN v_page v USING (page_id) WHERE triggered""",
)
def site_issue_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = rule_pages(spark, sf_dir)
    return audit.issue_list(issues(evaluate_rules(pages)), pages).select("crawl_id", "page_id", "code", "url", F.col("rank").cast("bigint").alias("rank"))


@query(
    "page_browser",
    f"""WITH {ctes("v_page")}, n AS (SELECT crawl_id, page_id, url, row_number() OVER (PARTITION BY crawl_id ORDER BY url, page_id) AS n, count(*) OVER (PARTITION BY crawl_id) AS total FROM v_page)
SELECT * FROM n WHERE n BETWEEN 21 AND 40""",
)
def page_browser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.page_browser(view(spark, sf_dir, "v_page"), 2, 20).select("crawl_id", "page_id", "url", F.col("n").cast("bigint").alias("n"), "total")


@query("page_redirects", f"WITH {ctes('v_page')} SELECT page_id, url, hops FROM v_page WHERE hops > 0")
def page_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.redirects(rule_pages(spark, sf_dir).drop("hops")).select("page_id", "url", F.col("hops").cast("bigint").alias("hops"))


@query(
    "page_duplicate_titles",
    f"""WITH {ctes("v_page")}, t AS (SELECT page_id, url, lower(trim(title)) AS k FROM v_page WHERE trim(title) <> ''),
g AS (SELECT k, list_sort(list_distinct(list(url)))[1:4] AS urls FROM t GROUP BY k HAVING count(*) > 1)
SELECT page_id, 'DUPLICATE_TITLE_TAG' AS code, 'High' AS severity, 'OnPage' AS category, array_to_string(list_filter(urls, lambda u: u <> url)[1:3], ', ') AS detail FROM t JOIN g USING (k)""",
)
def page_duplicate_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_titles(view(spark, sf_dir, "v_page"))


@query(
    "page_site_metrics",
    f"""WITH {ctes("v_page")} SELECT crawl_id, count(*) AS pages, avg(word_count) AS mean_words, avg(response_ms) AS mean_ms,
  avg(CAST(status = 200 AND page_id % 10 <> 4 AND page_id % 13 <> 5 AS INT)) AS indexable, avg(CAST(trim(title) <> '' AS INT)) AS with_title, avg(CAST(coalesce(meta_description, '') <> '' AS INT)) AS with_description FROM v_page GROUP BY crawl_id""",
)
def page_site_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = rule_pages(spark, sf_dir).withColumn("has_description", F.coalesce(F.col("meta_description") != "", F.lit(False))).withColumn("internal_links", F.lit(0))
    return competitors.site_metrics(pages, "crawl_id").drop("internal_links")


@query("page_links")
def extracted_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_links(extract_pages(read_table(spark, sf_dir, "pages"))).select("source_id", "normalized_target", "anchor", "is_internal", "is_nofollow")


@query("page_discovery")
def page_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = page_links(extract_pages(read_table(spark, sf_dir, "pages")))
    found = links.select((F.col("source_id") % 4).alias("crawl_id"), "target_url", F.lit(0).alias("depth"), F.regexp_extract("target_url", "://([^/?#:]+)", 1).alias("project_host"))
    known = read_table(spark, sf_dir, "pages").select((F.col("page_id") % 4).alias("crawl_id"), normalize_url(F.col("url")).alias("normalized_url"))
    return discover_urls(found, known)


@query(
    "page_normalized_urls",
    """WITH p AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages), q AS (
  SELECT page_id, regexp_replace(u, '[?].*$', '') AS base, CASE WHEN contains(u, '?') THEN regexp_replace(u, '^[^?]*[?]', '') ELSE '' END AS qs FROM p
), r AS (
  SELECT page_id, base, list_sort(list_distinct(list_filter(string_split(qs, '&'), lambda x: contains(x, '=') AND NOT starts_with(lower(x), 'utm_')))) AS l FROM q
)
SELECT page_id, regexp_replace(base, '/+$', '') || CASE WHEN len(l) = 0 THEN '' ELSE '?' || array_to_string(l, '&') END AS normalized_url FROM r""",
)
def page_normalized_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", normalize_url(F.col("url")).alias("normalized_url"))


# Documents: readability, key terms, duplicates


@query(
    "text_readability",
    r"""WITH s AS (
  SELECT doc_id, text, len(regexp_extract_all(text, '[\p{L}\p{N}]+(?:[\x{200C}-][\p{L}\p{N}]+)*')) AS words,
         list_filter(string_split(regexp_replace(text, '([.!?؟;\n])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, E' \t\n\r\v\f') <> '') AS parts FROM documents
), c AS (
  SELECT doc_id, words, greatest(len(parts), 1) AS sentences, len(list_filter(parts, lambda x: len(regexp_extract_all(x, '[\p{L}\p{N}]+(?:[\x{200C}-][\p{L}\p{N}]+)*')) > 25)) AS long_sentences FROM s
)
SELECT doc_id, words, sentences, long_sentences FROM c""",
)
def text_readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read_table(spark, sf_dir, "documents").select("doc_id", readability(F.col("text")).alias("r"))
    return found.select("doc_id", *[F.col(f"r.{c}").cast("bigint").alias(c) for c in ("words", "sentences", "long_sentences")])


@query("text_key_terms")
def text_key_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(top_terms(read_table(spark, sf_dir, "documents"), "doc_id"))


@query("text_content_summary")
def text_content_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.col("source").alias("crawl_id"), "text")
    return plain(audit.content_summary(audit.content_analysis(pages)))


@query("text_duplicate_clusters")
def text_duplicate_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = duplicate_clusters(read_table(spark, sf_dir, "documents"))
    return found.select("cluster", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"), F.col("similarity").cast("double").alias("similarity"), "exact")


# Links


_GRAPH = f"""{ctes("v_link", "v_node")}, e AS (
  SELECT DISTINCT source_id, target_id FROM v_link WHERE source_id IN (SELECT page_id FROM v_node) AND target_id IN (SELECT page_id FROM v_node)
), g AS (
  SELECT n.page_id, is_root, in_seeds, (SELECT count(*) FROM e WHERE e.target_id = n.page_id) AS in_degree, (SELECT count(*) FROM e WHERE e.source_id = n.page_id) AS out_degree FROM v_node n
), f AS (
  SELECT page_id, in_degree, out_degree, NOT is_root AND in_seeds AND in_degree = 0 AS is_orphan, NOT is_root AND in_degree <= 1 AS is_weak, out_degree = 0 AND in_degree > 0 AS is_dead_end FROM g
)"""


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return view(spark, sf_dir, "v_node"), view(spark, sf_dir, "v_link")


@query("link_degrees", f"WITH {_GRAPH} SELECT * FROM f")
def link_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_graph(*_graph(spark, sf_dir))


@query(
    "link_findings",
    f"""WITH {_GRAPH} SELECT page_id, 'ORPHAN_PAGE' AS code, 'High' AS severity FROM f WHERE is_orphan UNION ALL SELECT page_id, 'DEAD_END_PAGE', 'Medium' FROM f WHERE is_dead_end""",
)
def link_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_issues(link_graph(*_graph(spark, sf_dir))).select("page_id", "code", "severity")


@query(
    "link_totals",
    f"""WITH {_GRAPH} SELECT (SELECT count(*) FROM v_link WHERE source_id IN (SELECT page_id FROM v_node) AND target_id IN (SELECT page_id FROM v_node)) AS total_links,
  count(*) FILTER (is_orphan) AS orphan_pages, count(*) FILTER (is_dead_end) AS dead_end_pages, count(*) FILTER (is_weak) AS weak_pages FROM f""",
)
def link_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_summary(*_graph(spark, sf_dir))


@query(
    "link_anchors",
    f"""WITH {ctes("v_link", "v_node")}, v AS (SELECT trim(anchor) AS a FROM v_link WHERE source_id IN (SELECT page_id FROM v_node) AND target_id IN (SELECT page_id FROM v_node) AND trim(anchor) <> '')
SELECT min(a) AS anchor, count(*) AS n, lower(min(a)) IN ('here', 'read more') AS is_generic FROM v GROUP BY lower(a) ORDER BY n DESC, lower(min(a)) LIMIT 50""",
)
def link_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_anchors(*_graph(spark, sf_dir))


@query(
    "link_generic_anchors",
    f"""WITH {ctes("v_link")} SELECT source_id AS page_id, 'GENERIC_ANCHOR_TEXT' AS code, 'Low' AS severity, 'InternalLinks' AS category, count(*) || ': ' || array_to_string(list_sort(list_distinct(list(anchor)))[1:3], ', ') AS detail
FROM v_link WHERE lower(trim(anchor)) IN ('here', 'read more') GROUP BY source_id""",
)
def link_generic_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generic_anchor_issues(view(spark, sf_dir, "v_link"))


def _authority_sql(rounds: int = 20) -> str:
    steps = [
        f"""r{i} AS (SELECT page_id, 0.15 / n.c + 0.85 * (l.lost / n.c + coalesce(p.got, 0)) AS r FROM r{i - 1}
  LEFT JOIN (SELECT target_id, sum(r / o.out) AS got FROM e JOIN r{i - 1} ON e.source_id = page_id JOIN o USING (source_id) GROUP BY target_id) p ON p.target_id = page_id,
  n, (SELECT coalesce(sum(r), 0) AS lost FROM r{i - 1} WHERE page_id NOT IN (SELECT source_id FROM o)) l)"""
        for i in range(1, rounds + 1)
    ]
    return f"""WITH {ctes("v_link", "v_node")}, e AS MATERIALIZED (
  SELECT DISTINCT source_id, target_id FROM v_link WHERE source_id IN (SELECT page_id FROM v_node) AND target_id IN (SELECT page_id FROM v_node)
), o AS MATERIALIZED (SELECT source_id, count(*) AS out FROM e GROUP BY source_id), n AS MATERIALIZED (SELECT CAST(count(*) AS DOUBLE) AS c FROM v_node),
r0 AS MATERIALIZED (SELECT page_id, 1 / n.c AS r FROM v_node, n), {", ".join(s.replace(" AS (", " AS MATERIALIZED (", 1) for s in steps)}
SELECT page_id, round_even(r / (SELECT max(r) FROM r{rounds}) * 100, 2) AS authority FROM r{rounds}"""


@query("link_authority", _authority_sql())
def link_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return internal_authority(*_graph(spark, sf_dir))


# Keywords



def _half_even(num: str, den: str, scale: int) -> str:
    """SQL of a quotient of whole numbers times ``scale``, rounded half to even, over ``scale``; 0 over 0 is 0."""
    n, d = f"({num}) * {scale}", f"greatest({den}, 1)"
    return f"(({n}) // {d} + CASE WHEN 2 * (({n}) % {d}) > {d} OR (2 * (({n}) % {d}) = {d} AND (({n}) // {d}) % 2 = 1) THEN 1 ELSE 0 END) / CAST({scale} AS DOUBLE)"


_CTR = _half_even("CAST(sum(clicks) AS BIGINT)", "CAST(sum(impressions) AS BIGINT)", 10_000)
_MEAN = _half_even("CAST(sum(position * impressions) AS BIGINT)", "CAST(sum(impressions) AS BIGINT)", 100)
_WEIGHTED = "CASE WHEN sum(impressions) = 0 THEN avg(CAST(position AS DECIMAL(18,6))) ELSE CAST(sum(position * impressions) AS DECIMAL(28,6)) / sum(impressions) END"


def _keywords(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return view(spark, sf_dir, "v_keyword"), view(spark, sf_dir, "v_metric")


@query(
    "keyword_history",
    f"""WITH {ctes("v_metric")}, d AS (SELECT project_id, keyword_id, date, round_even(CAST({_WEIGHTED} AS DOUBLE), 2) AS position, CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(clicks) AS BIGINT) AS clicks FROM v_metric GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id, keyword_id ORDER BY date DESC) AS back FROM d) WHERE back <= 14""",
)
def keyword_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(keywords.keyword_history(view(spark, sf_dir, "v_metric")).withColumn("back", F.col("back").cast("bigint")))


@query(
    "keyword_opportunities",
    f"""WITH {ctes("v_metric", "v_keyword")}, g AS (
  SELECT project_id, keyword_id, CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(position * impressions) AS DOUBLE) / greatest(1, sum(impressions)) AS average, arg_min(page_url, (-clicks, page_url)) AS best_page, {_CTR} AS ctr, {_MEAN} AS mean
  FROM v_metric GROUP BY project_id, keyword_id
)
SELECT project_id, keyword_id, phrase, impressions, clicks, ctr, mean AS average, best_page, CAST(floor(greatest(least(100 - (average - 4) * 5 + least(20, impressions / 100), 100), 0) + 1e-9) AS INT) AS score
FROM g JOIN v_keyword USING (project_id, keyword_id) WHERE average BETWEEN 4 AND 15 AND impressions >= 10 AND floor(greatest(least(100 - (average - 4) * 5 + least(20, impressions / 100), 100), 0) + 1e-9) > 0""",
)
def keyword_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(keywords.keyword_opportunities(*_keywords(spark, sf_dir)))


_OVERVIEW = f"""{ctes("v_metric", "v_keyword")}, t AS (
  SELECT project_id, keyword_id, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions, arg_min(page_url, (-clicks, page_url)) AS best_page, arg_max(source, (date, source)) AS source, {_CTR} AS ctr, {_MEAN} AS position FROM v_metric GROUP BY project_id, keyword_id
), d AS (SELECT project_id, keyword_id, date, round_even(CAST({_WEIGHTED} AS DOUBLE), 2) AS position FROM v_metric GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY project_id, keyword_id ORDER BY date DESC) AS k FROM d),
c AS (SELECT project_id, keyword_id, max(position) FILTER (k = 1) AS current_position, max(position) FILTER (k = 2) AS previous_position FROM b GROUP BY ALL),
o AS (
  SELECT project_id, keyword_id, phrase, is_tracked, clicks, impressions, ctr, position, best_page, coalesce(source, 'none') AS source, current_position, previous_position,
    CAST(round_even(CAST(previous_position - current_position AS DECIMAL(10,2)), 1) AS DOUBLE) AS delta FROM v_keyword LEFT JOIN t USING (project_id, keyword_id) LEFT JOIN c USING (project_id, keyword_id)
), overview AS (
  SELECT *, CASE WHEN current_position IS NULL THEN 'stable' WHEN previous_position IS NULL THEN 'new' WHEN delta > 0.5 THEN 'up' WHEN delta < -0.5 THEN 'down' ELSE 'stable' END AS trend FROM o
)"""
_CLASHES = f"""pg AS (
  SELECT project_id, keyword_id, trim(page_url) AS page, CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(clicks) AS BIGINT) AS clicks, round_even(CAST({_WEIGHTED} AS DOUBLE), 1) AS position FROM v_metric GROUP BY ALL
), pr AS (
  SELECT *, row_number() OVER (PARTITION BY project_id, keyword_id ORDER BY impressions DESC, page) AS k, sum(impressions) OVER (PARTITION BY project_id, keyword_id) AS total FROM pg WHERE impressions > 0 OR clicks > 0
), pc AS (
  SELECT project_id, keyword_id, count(*) AS n_pages, CAST(max(total) AS BIGINT) AS total, max(impressions) FILTER (k = 2) AS second, max(position) FILTER (k = 2) AS second_position, string_agg(page || '=' || impressions || '/' || clicks, ',' ORDER BY k) AS pages FROM pr GROUP BY ALL
), clashes AS (
  SELECT project_id, keyword_id, phrase, CASE WHEN second * 100.0 / total >= 30 AND second_position <= 30 THEN 'High' ELSE 'Medium' END AS severity, n_pages, total, {_half_even("second * 100", "total", 10)} AS second_share, pages
  FROM pc JOIN v_keyword USING (project_id, keyword_id) WHERE n_pages >= 2 AND total >= 10 AND second * 100.0 / total >= 15
)"""


@query("keyword_overview", f"WITH {_OVERVIEW} SELECT * FROM overview")
def keyword_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(keywords.keyword_overview(*_keywords(spark, sf_dir)))


@query("keyword_cannibalization", f"WITH {ctes('v_metric', 'v_keyword')}, {_CLASHES} SELECT * FROM clashes")
def keyword_cannibalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = keywords.keyword_cannibalization(*_keywords(spark, sf_dir))
    pages = F.transform("pages", lambda p: F.concat(p["page"], F.lit("="), p["impressions"].cast("string"), F.lit("/"), p["clicks"].cast("string")))
    return plain(found.withColumn("pages", pages))


@query(
    "keyword_summary",
    f"""WITH {_OVERVIEW}, {_CLASHES}
SELECT project_id, count(*) FILTER (is_tracked) AS tracked, count(*) FILTER (current_position <= 3) AS top_3, count(*) FILTER (current_position <= 10) AS top_10, count(*) FILTER (current_position <= 20) AS top_20,
  count(*) FILTER (current_position <= 100) AS top_100, count(*) FILTER (trend = 'up') AS improved, count(*) FILTER (trend = 'down') AS declined, CAST(sum(coalesce(impressions, 0)) AS BIGINT) AS impressions,
  CAST(sum(coalesce(clicks, 0)) AS BIGINT) AS clicks, (SELECT count(*) FROM clashes c WHERE c.project_id = overview.project_id) AS cannibalised FROM overview GROUP BY project_id""",
)
def keyword_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.keyword_summary(*_keywords(spark, sf_dir))


# Competitors


def _rivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_rival")


@query(
    "competitor_comparison",
    f"""WITH {ctes("v_rival")}, l AS (SELECT competitor_id, max(created_at) AS newest FROM v_rival GROUP BY ALL)
SELECT competitor_id, count(*) AS pages, avg(word_count) AS mean_words, avg(response_ms) AS mean_ms, avg(CAST(is_indexable AS INT)) AS indexable, avg(CAST(trim(title) <> '' AS INT)) AS with_title, CAST(sum(internal_links) AS BIGINT) AS internal_links
FROM v_rival JOIN l USING (competitor_id) WHERE created_at = newest GROUP BY competitor_id""",
)
def competitor_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _rivals(spark, sf_dir)
    crawls = pages.select("competitor_id", "crawl_id", "created_at").distinct().withColumn("status", F.lit("Completed"))
    sites = pages.select("competitor_id", F.col("competitor_id").alias("name")).distinct().withColumn("is_active", F.lit(True))
    return competitors.compare_competitors(sites, crawls, pages).select("competitor_id", "pages", "mean_words", "mean_ms", "indexable", "with_title", "internal_links")


@query(
    "competitor_digest",
    f"""WITH {ctes("v_rival")} SELECT crawl_id, count(*) AS pages, count(*) FILTER (status >= 400) AS errors, avg(word_count) AS mean_words, count(*) FILTER (is_indexable) AS indexable, count(*) FILTER (trim(title) <> '') AS with_title FROM v_rival GROUP BY crawl_id""",
)
def competitor_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return competitors.competitor_snapshot(_rivals(spark, sf_dir)).select("crawl_id", "pages", "errors", "mean_words", "indexable", "with_title")


@query(
    "competitor_topic_gaps",
    f"""WITH {ctes("v_rival")}, y AS (SELECT competitor_id, url, word_count, created_at, lower(trim(string_split(title, '|')[1])) AS topic FROM v_rival WHERE trim(title) <> ''),
own AS (SELECT lower(trim(string_split(title, '|')[1])) AS topic, max(word_count) AS words FROM v_rival WHERE trim(title) <> '' AND created_at = 0 AND competitor_id = 'BUILDING' GROUP BY 1),
r AS (SELECT * FROM y WHERE created_at = 2),
m AS (SELECT a.topic, min(o.topic) AS own FROM (SELECT DISTINCT topic FROM r) a JOIN own o ON contains(o.topic, a.topic) OR contains(a.topic, o.topic) GROUP BY 1),
x AS (SELECT r.*, m.own, CASE WHEN m.own IS NULL THEN 'MissingInProject' WHEN word_count > words * 1.5 AND word_count >= 300 THEN 'CompetitorHasDeeperContent' END AS kind FROM r LEFT JOIN m USING (topic) LEFT JOIN own o ON o.topic = m.own),
t AS (SELECT competitor_id, count(*) FILTER (own IS NOT NULL) AS common, count(*) FILTER (own IS NULL) AS missing FROM x GROUP BY competitor_id),
g AS (SELECT competitor_id, row_number() OVER (PARTITION BY competitor_id ORDER BY url) AS rank, topic, url, CAST(word_count AS BIGINT) AS word_count, kind FROM x WHERE kind IS NOT NULL QUALIFY rank <= 25)
SELECT * FROM t LEFT JOIN g USING (competitor_id)""",
)
def competitor_topic_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _rivals(spark, sf_dir)
    own = pages.filter("created_at = 0 and competitor_id = 'BUILDING'")
    return plain(competitors.topic_gaps(own, pages.filter("created_at = 2")))


# Search results and backlinks


@query(
    "serp_comparison",
    f"""WITH {ctes("v_serp")}, a AS (SELECT keyword_id, regexp_replace(substr(url, 9), '/+$', '') AS key, old_rank FROM v_serp WHERE in_old), b AS (SELECT keyword_id, regexp_replace(substr(url, 9), '/+$', '') AS key, new_rank FROM v_serp WHERE in_new)
SELECT keyword_id, key, old_rank AS old_position, new_rank AS new_position, old_rank - new_rank AS delta,
  CASE WHEN old_rank IS NULL THEN 'entered' WHEN new_rank IS NULL THEN 'dropped' WHEN old_rank > new_rank THEN 'improved' WHEN old_rank < new_rank THEN 'declined' ELSE 'unchanged' END AS kind
FROM a FULL JOIN b USING (keyword_id, key)""",
)
def serp_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, "v_serp")
    old = v.filter("in_old").select("keyword_id", "url", F.col("old_rank").alias("position"))
    return snapshots.serp_compare(old, v.filter("in_new").select("keyword_id", "url", F.col("new_rank").alias("position")), "keyword_id")


@query(
    "serp_own_position",
    f"""WITH {ctes("v_serp")} SELECT keyword_id AS snapshot_id, min(CASE WHEN url LIKE '%-000000001%' THEN old_rank END) AS own_position FROM v_serp GROUP BY keyword_id""",
)
def serp_own_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, "v_serp").select(F.col("keyword_id").alias("snapshot_id"), "url", F.col("old_rank").alias("position"))
    return snapshots.own_position(v, F.when(F.col("url").contains("-000000001"), F.regexp_extract("url", "//www.([^/]+)/", 1)).otherwise("none.example"))


_LINKS = "concat('http://s', CAST(l_suppkey AS STRING), '.example/') AS source_url, concat('/P', CAST(l_partkey % 50 AS STRING)) AS target_url"


@query(
    "backlink_changes",
    f"""WITH a AS (SELECT DISTINCT lower(source_url || '|' || target_url) AS key FROM (SELECT {_LINKS} FROM lineitem WHERE l_shipdate < '1997-06-01')), b AS (SELECT DISTINCT lower(source_url || '|' || target_url) AS key FROM (SELECT {_LINKS} FROM lineitem WHERE l_shipdate >= '1997-06-01'))
SELECT key, 'added' AS change FROM b ANTI JOIN a USING (key) UNION ALL SELECT key, 'removed' FROM a ANTI JOIN b USING (key)""",
)
def backlink_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read_table(spark, sf_dir, "lineitem")
    source = F.concat(F.lit("http://s"), F.col("l_suppkey").cast("string"), F.lit(".example/")).alias("source_url")
    target = F.concat(F.lit("/P"), (F.col("l_partkey") % 50).cast("string")).alias("target_url")
    before = line.filter("l_shipdate < '1997-06-01'").select(source, target)
    after = line.filter("l_shipdate >= '1997-06-01'").select(source, target)
    return snapshots.backlink_diff(before, after)


# Accounts


@query(
    "account_usage",
    f"""WITH {ctes("v_usage")}, p AS (SELECT DISTINCT c_nationkey AS owner_id, c_custkey AS project_id FROM customer WHERE c_custkey % 10 <> 3)
SELECT owner_id, count(*) AS projects, coalesce((SELECT count(*) FROM v_usage v WHERE v.owner_id = p.owner_id AND project_status <> 'Archived' AND started_at >= '1997-05-01' AND started_at < '1997-06-01'), 0) AS pages,
  coalesce((SELECT count(*) FROM part JOIN p q ON q.project_id = p_partkey WHERE q.owner_id = p.owner_id), 0) AS keywords, coalesce((SELECT count(*) FROM supplier JOIN p q ON q.project_id = s_suppkey WHERE q.owner_id = p.owner_id), 0) AS competitors,
  coalesce((SELECT count(DISTINCT o_orderkey % 40) FROM orders JOIN p q ON q.project_id = o_custkey WHERE q.owner_id = p.owner_id), 0) AS members FROM p GROUP BY owner_id""",
)
def account_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, "v_usage")
    customer = read_table(spark, sf_dir, "customer")
    projects = customer.select(F.col("c_nationkey").alias("owner_id"), F.col("c_custkey").alias("project_id"), F.when(F.col("c_custkey") % 10 == 3, "Archived").otherwise("Active").alias("status"))
    crawls = v.select(F.col("page_id").alias("crawl_id"), "project_id", "started_at")
    phrases, rivals = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("project_id")), read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("project_id"))
    members = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project_id"), (F.col("o_orderkey") % 40).alias("user_id"))
    return accounts.usage(projects, crawls, v.select(F.col("page_id").alias("crawl_id")), phrases, rivals, members, F.lit("1997-05-17").cast("timestamp"))


@query(
    "account_alert_cooldown",
    """WITH c AS (SELECT event_id, user_id AS rule_id, ts FROM events WHERE event_type = 'error' AND event_id % 2 = 0), e AS (SELECT user_id AS rule_id, ts FROM events WHERE event_type = 'error' AND event_id % 2 = 1 AND ts < '2024-01-10'),
f AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.rule_id = c.rule_id AND e.ts > c.ts - INTERVAL 24 HOUR AND e.ts <= c.ts))
SELECT event_id, rule_id FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY ts, event_id) AS k FROM f) WHERE k = 1""",
)
def account_alert_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = read_table(spark, sf_dir, "events").filter("event_type = 'error'").select("event_id", F.col("user_id").alias("rule_id"), F.col("ts").alias("detected_at"))
    old = errors.filter("event_id % 2 = 1 and detected_at < '2024-01-10'")
    return accounts.alert_cooldown(errors.filter("event_id % 2 = 0"), old).select("event_id", "rule_id")


# Streams: each reads its table as a stream of files to the end


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # As a pattern: a stream takes a plain path for a folder, and a table may be one file.
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{name}.parquet").schema).parquet(f"{sf_dir}/{name}.parque[t]")


@query(
    "stream_usage",
    "SELECT user_id AS owner_id, CAST(date_trunc('month', ts) AS TIMESTAMP) AS month, count(*) AS pages FROM events WHERE event_type = 'view' GROUP BY ALL",
)
def stream_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _stream(spark, sf_dir, "events").filter("event_type = 'view'").select(F.col("user_id").alias("owner_id"), F.col("ts").cast("timestamp").alias("ts"))
    out = fresh_path(spark, "stream-usage")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    running = streams.stream_counts(events)
    query = running.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", fresh_path(spark, "stream-usage-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    # A month's count only grows; its last update is the largest.
    return spark.read.schema(running.schema).parquet(f"{out}/epoch=*").groupBy("owner_id", "month").agg(F.max("pages").alias("pages"))


@query("stream_new_metrics", "SELECT DISTINCT l_partkey AS keyword_id, CAST(l_shipdate AS DATE) AS date, l_suppkey % 4 AS page FROM lineitem")
def stream_new_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stream(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("keyword_id"), F.col("l_shipdate").cast("date").alias("date"), (F.col("l_suppkey") % 4).alias("page"))
    out = fresh_path(spark, "stream-metrics")
    streams.stream_new_rows(rows, ["keyword_id", "date", "page"], out, fresh_path(spark, "stream-metrics-state")).awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{out}/epoch=*")


# Newest rows, retention, limits, ingestion


@query("crawl_latest", "SELECT project_id, crawl_id, rank FROM (SELECT o_custkey AS project_id, o_orderkey AS crawl_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank FROM orders) WHERE rank <= 3")
def crawl_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    crawls = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("crawl_id"), F.col("o_orderdate").alias("created_at"))
    return audit.latest_per(crawls, "project_id", "created_at", "crawl_id", 3).select("project_id", "crawl_id", F.col("rank").cast("bigint").alias("rank"))


@query(
    "serp_results",
    f"""WITH {ctes("v_serp")} SELECT keyword_id AS snapshot_id, url, old_rank AS position, count(*) OVER (PARTITION BY keyword_id) > 5 AS truncated FROM v_serp WHERE keyword_id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY keyword_id ORDER BY old_rank, url) <= 5""",
)
def serp_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, "v_serp").select(F.col("keyword_id").alias("snapshot_id"), "url", F.col("old_rank").alias("position"))
    state = v.select("snapshot_id", F.when(F.col("snapshot_id") % 3 == 0, "Unavailable").otherwise("Available").alias("availability")).distinct()
    return snapshots.serp_results(state, v, 5).select("snapshot_id", "url", "position", "truncated")


@query(
    "serp_ingest",
    f"""WITH {ctes("v_serp")}, v AS (SELECT *, row_number() OVER (PARTITION BY keyword_id ORDER BY old_rank, url) AS k, count(*) OVER (PARTITION BY keyword_id) AS total FROM v_serp)
SELECT keyword_id AS snapshot_id, least(total, 4) AS result_count, total > 4 AS truncated, min(CASE WHEN url LIKE '%-000000007.example/%' AND k <= 4 THEN old_rank END) AS own_position, min(CASE WHEN url LIKE '%-000000007.example/%' AND k <= 4 THEN url END) AS own_url,
  sha256(string_agg(lpad(CAST(k AS VARCHAR), 6, '0') || '|' || old_rank || '|' || url || '|t', chr(10) ORDER BY k) FILTER (k <= 4)) AS payload_hash FROM v GROUP BY keyword_id, total""",
)
def serp_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = view(spark, sf_dir, "v_serp").select(F.col("keyword_id").alias("snapshot_id"), F.col("old_rank").alias("position"), "url", F.lit("t").alias("title"))
    return ingest.ingest_serp(payload, "supplier-000000007.example", 4)[1].select("snapshot_id", "result_count", "truncated", "own_position", "own_url", "payload_hash")


@query(
    "backlink_ingest",
    """WITH r AS (SELECT l_suppkey AS snapshot_id, concat('http://s', l_partkey % 90, '.example/') AS s, concat('/t', l_partkey) AS t, l_returnflag AS a, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey) AS k FROM lineitem)
SELECT snapshot_id, least(count(*), 100) AS observation_count, count(*) > 100 AS truncated, sha256(string_agg(lpad(CAST(k AS VARCHAR), 6, '0') || '|' || s || '|' || t || '|' || a, chr(10) ORDER BY k) FILTER (k <= 100)) AS payload_hash FROM r GROUP BY snapshot_id""",
)
def backlink_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("snapshot_id"), (F.col("l_orderkey") * 1_000_000 + F.col("l_linenumber") * 100_000 + F.col("l_partkey")).alias("ordinal"),
        F.concat(F.lit("http://s"), (F.col("l_partkey") % 90).cast("string"), F.lit(".example/")).alias("source_url"), F.concat(F.lit("/t"), F.col("l_partkey").cast("string")).alias("target_url"), F.col("l_returnflag").alias("anchor"),
    )
    return ingest.ingest_backlinks(payload, 100)[1].select("snapshot_id", "observation_count", "truncated", "payload_hash")


@query(
    "keyword_ingest",
    """WITH p AS (SELECT p_partkey % 7 AS project_id, p_partkey AS ordinal, trim(p_name) AS phrase FROM part), o AS (SELECT project_id, lower(phrase) AS k, min(ordinal) AS ordinal FROM p GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY ordinal) AS n FROM o), a AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY ordinal) AS m FROM f WHERE n <= 100 AND NOT starts_with(k, 'red'))
SELECT project_id, k AS normalized_phrase FROM a WHERE m <= 12""",
)
def keyword_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrases = read_table(spark, sf_dir, "part").select((F.col("p_partkey") % 7).alias("project_id"), F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("phrase"))
    known = phrases.filter(F.lower("phrase").startswith("red")).select("project_id", F.lower("phrase").alias("normalized_phrase")).distinct()
    return ingest.ingest_keywords(phrases, known, 12)[0].select("project_id", "normalized_phrase")


@query(
    "keyword_valid_metrics",
    "SELECT l_orderkey, l_linenumber, upper(CASE WHEN l_returnflag = 'N' THEN 'ALL' ELSE l_returnflag END) AS country, CAST(round_even(CAST(l_discount AS DECIMAL(18,10)), 6) AS DOUBLE) AS ctr FROM lineitem WHERE l_quantity - 10 >= 0",
)
def keyword_valid_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") - 10).alias("clicks"), F.col("l_quantity").alias("impressions"), F.col("l_tax").alias("position"), F.col("l_discount").alias("ctr"),
        F.when(F.col("l_returnflag") == "N", " ").otherwise(F.lower("l_returnflag")).alias("country"), F.lit("").alias("device"),
    )
    return plain(keywords.valid_metrics(rows)[0].select("l_orderkey", "l_linenumber", "country", "ctr"))


@query(
    "account_limits",
    """WITH u AS (SELECT c_nationkey AS owner_id, count(*) AS projects, CAST(sum(c_custkey) AS BIGINT) AS pages FROM customer GROUP BY ALL),
p AS (SELECT owner_id, CASE WHEN owner_id % 5 = 4 THEN 'free' ELSE ['free', 'starter', 'pro', 'enterprise'][owner_id % 4 + 1] END AS plan, owner_id % 5 <> 4 AS is_active FROM u),
l(plan, max_projects, max_pages, max_keywords, max_competitors, max_ai_credits) AS (VALUES ('free', 1, 100, 10, 1, 5), ('starter', 3, 1000, 25, 3, 25), ('pro', 10, 10000, 150, 10, 100), ('enterprise', 50, 100000, 1000, 50, 500))
SELECT owner_id, plan, is_active, CAST(max_ai_credits AS BIGINT) AS max_ai_credits, projects >= max_projects AS projects_full, pages + 1 > max_pages AS pages_full, projects * 3 >= max_keywords AS keywords_full, owner_id >= max_competitors AS competitors_full FROM u JOIN p USING (owner_id) JOIN l USING (plan)""",
)
def account_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = read_table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("owner_id")).agg(F.count(F.lit(1)).alias("projects"), F.sum("c_custkey").alias("pages"))
    used = used.withColumn("keywords", F.col("projects") * 3).withColumn("competitors", F.col("owner_id"))
    names = F.array(*[F.lit(p) for p in ("free", "starter", "pro", "enterprise")])
    bought = used.select("owner_id", F.element_at(names, F.col("owner_id") % 4 + 1).alias("plan"), F.when(F.col("owner_id") % 5 == 4, "Canceled").otherwise("Active").alias("status"), F.lit(None).cast("timestamp").alias("period_end"))
    limits = accounts.entitlements(used, bought, F.current_timestamp())
    return plain(limits.select("owner_id", "plan", "is_active", "max_ai_credits").join(accounts.quota_check(used, limits), "owner_id"))


@query(
    "account_expired_rows",
    """SELECT event_type AS status, count(*) FILTER (CASE event_type WHEN 'view' THEN ts < TIMESTAMP '2024-01-21' WHEN 'click' THEN ts < TIMESTAMP '2024-01-30' ELSE false END) AS expired, count(*) AS total FROM events GROUP BY event_type""",
)
def account_expired_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "events").select("event_id", "ts", F.col("event_type").alias("status"))
    kept, gone = audit.kept_rows(rows, "ts", {"view": 10, "click": 0}, F.lit("2024-01-31").cast("timestamp"))
    both = kept.withColumn("gone", F.lit(False)).unionByName(gone.withColumn("gone", F.lit(True)))
    return both.groupBy("status").agg(F.count_if("gone").alias("expired"), F.count(F.lit(1)).alias("total"))


@query(
    "account_visible_projects",
    "SELECT DISTINCT * FROM (SELECT c_nationkey AS user_id, c_custkey AS project_id FROM customer UNION ALL SELECT CAST(o_orderkey % 40 AS INT), o_custkey FROM orders WHERE o_orderstatus IN ('F', 'O'))",
)
def account_visible_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    projects = read_table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("owner_id"), F.col("c_custkey").alias("project_id"))
    role = F.when(F.col("o_orderstatus") == "F", "Viewer").when(F.col("o_orderstatus") == "O", "Admin").otherwise("Guest")
    members = read_table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 40).cast("int").alias("user_id"), F.col("o_custkey").alias("project_id"), role.alias("role"))
    return audit.visible_projects(projects, members)


@query(
    "account_delivery_backlog",
    """SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank, least(60, CAST(2 ** least(6, event_id % 11) AS INT)) AS backoff_minutes, event_id % 11 + 1 >= 10 AS dead_letter
FROM events WHERE event_type IN ('error', 'view') AND ts <= TIMESTAMP '2024-01-15'""",
)
def account_delivery_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "Failed").when(F.col("event_type") == "view", "Pending").otherwise("Delivered")
    rows = read_table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("project_id"), status.alias("status"), F.col("ts").alias("next_attempt_at"), F.lit(None).cast("timestamp").alias("locked_until"), (F.col("event_id") % 11).alias("attempts")
    )
    found = audit.delivery_backlog(rows, F.lit("2024-01-15").cast("timestamp"))
    return found.select(F.col("id").alias("event_id"), F.col("rank").cast("bigint").alias("rank"), "backoff_minutes", "dead_letter")

