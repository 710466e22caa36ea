"""More registered queries: text and page evidence, robots, reports, records, visibility, alerts, streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.evidence import is_indexable, question_heading, structured_data
from ..functions.extract import extract_pages
from ..functions.text import STOP_WORDS, content_hash, csv_safe, normalize_text, shingles, similarity
from ..functions.urls import is_wildcard_query
from ..operators import evidence, robots
from ..operators.duplicates import duplicate_clusters, duplicate_issues
from ..operators.links import resolve_links
from ..operators.rule_texts import DESCRIPTION, TITLES, with_texts
from ..operators.rules import evaluate_rules, page_rules
from ..operators.scoring import issues, scores
from ..sources import ingest
from ..sources.tables import read_raw_pages, read_table, report, reports_list, write_crawl_rows, write_report
from ..streaming import streams
from . import accounts, audit, catalog, competitors, snapshots, visibility
from .durable import Scratch, fresh_path
from .expected import markup_text, rule_ctes
from .registry import ORACLES, QUERIES, plain, query
from .views import ctes, rule_pages, view

__all__ = ["ORACLES", "QUERIES"]

# Texts

_WORD = r"[\p{L}\p{N}]+(?:[\x{200C}-][\p{L}\p{N}]+)*"
_NORM = r"trim(regexp_replace(regexp_replace(translate(lower(nfc_normalize(text)), 'يىك', 'ییک'), '[\p{Mn}ـ]', '', 'g'), '[^\p{L}\p{N}\x{200C}]+', ' ', 'g'))"
_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
TERMS = rf"""ws AS (SELECT doc_id, list_transform(regexp_extract_all(text, '{_WORD}'), lambda x: lower(x)) AS w FROM documents),
us AS (SELECT doc_id, len(w) AS total, unnest(w) AS a, generate_subscripts(w, 1) AS p FROM ws),
vs AS (SELECT *, lead(a) OVER (PARTITION BY doc_id ORDER BY p) AS b FROM us),
ts AS (
  SELECT doc_id, total, a AS term, 1 AS size FROM vs WHERE length(a) >= 3 AND a NOT IN ({_STOPS}) AND NOT (regexp_full_match(a, '[0-9]+') AND try_cast(a AS INTEGER) IS NOT NULL)
  UNION ALL SELECT doc_id, total, a || ' ' || b, 2 FROM vs WHERE b IS NOT NULL AND length(a) >= 2 AND length(b) >= 2 AND NOT (a IN ({_STOPS}) AND b IN ({_STOPS}))
), cs AS (SELECT doc_id, total, term, size, count(*) AS n FROM ts GROUP BY ALL HAVING count(*) >= 2),
hs AS (SELECT *, (n * size * 10000) // total AS q, (n * size * 10000) % total AS r FROM cs),
ds AS (SELECT doc_id, term, size, n, q + CASE WHEN 2 * r > total OR (2 * r = total AND q % 2 = 1) THEN 1 ELSE 0 END AS d FROM hs),
terms AS (
  SELECT doc_id, term, size, n, d / 100.0 AS density, CASE WHEN size = 1 THEN d >= 350 AND n >= 4 ELSE d >= 250 AND n >= 3 END AS stuffing,
         row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, d DESC, size, term) AS rank FROM ds QUALIFY rank <= 30
)"""
ORACLES["text_key_terms"] = f"WITH {TERMS} SELECT doc_id, term, n, CAST(density AS DOUBLE) AS density, CAST(size AS BIGINT) AS size, stuffing, rank FROM terms"
QUERIES["text_key_terms"] = lambda spark, sf_dir, f=QUERIES["text_key_terms"]: plain(f(spark, sf_dir))

#: White space by Unicode, and a quotient of whole numbers to one place, half to even, in tenths; doubles would round 23 / 80 down.
_SPACE = r"\t-\r\x{85}\p{Z}"
_TENTHS = "({0}) // ({1}) + CASE WHEN 2 * (({0}) % ({1})) > ({1}) OR (2 * (({0}) % ({1})) = ({1}) AND ({0}) // ({1}) % 2 = 1) THEN 1 ELSE 0 END"
READS = rf"""rt AS (
  SELECT doc_id, source, translate(coalesce(text, ''), chr(1), chr(2)) AS text FROM documents
), rs AS (
  SELECT doc_id, source, text, NOT regexp_matches(text, '[^{_SPACE}]') AS empty, len(regexp_extract_all(text, '{_WORD}')) AS words,
         list_filter(string_split(regexp_replace(text, '([.!?؟;\n])[{_SPACE}]+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_matches(x, '[^{_SPACE}]')) AS parts,
         greatest(len(list_filter(string_split(regexp_replace(text, '\r\n\r\n|\n\n', chr(1), 'g'), chr(1)), lambda x: x <> '')), 1) AS paragraphs FROM rt
), rc AS (
  SELECT *, greatest(len(parts), 1) AS sentences, len(list_filter(parts, lambda x: len(regexp_extract_all(x, '{_WORD}')) > 25)) AS long_sentences FROM rs
), rq AS (
  SELECT *, {_TENTHS.format("10 * words", "sentences")} AS average_tenths, {_TENTHS.format("1000 * long_sentences", "sentences")} AS long_tenths FROM rc
), rm AS (
  SELECT *, average_tenths / 10 AS average_sentence, long_tenths / 10 AS long_share, greatest(10000 - greatest(average_tenths - 150, 0) * 20 - long_tenths * 4, 0) AS hundredths FROM rq
), rd AS (
  SELECT *, ({_TENTHS.format("hundredths", "10")}) / 10 AS score FROM rm
), reads AS (
  SELECT doc_id, source, text, CASE WHEN empty THEN 0 ELSE words END AS words, CASE WHEN empty THEN 0 ELSE sentences END AS sentences, CASE WHEN empty THEN 0 ELSE average_sentence END AS average_sentence,
         CASE WHEN empty THEN 0 ELSE long_sentences END AS long_sentences, CASE WHEN empty THEN 0 ELSE long_share END AS long_share, CASE WHEN empty THEN 0 ELSE paragraphs END AS paragraphs,
         CASE WHEN empty THEN 0 ELSE score END AS score, CASE WHEN empty OR score < 35 THEN 'VeryDifficult' WHEN score >= 75 THEN 'Easy' WHEN score >= 55 THEN 'Standard' ELSE 'Difficult' END AS grade FROM rd
)"""
ORACLES["text_readability"] = f"""WITH {READS} SELECT doc_id, CAST(words AS BIGINT) AS words, CAST(sentences AS BIGINT) AS sentences, CAST(average_sentence AS DOUBLE) AS average_sentence, CAST(long_sentences AS BIGINT) AS long_sentences,
  CAST(long_share AS DOUBLE) AS long_share, CAST(paragraphs AS BIGINT) AS paragraphs, CAST(score AS DOUBLE) AS score, grade FROM reads"""


def _readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import readability

    return plain(read_table(spark, sf_dir, "documents").select("doc_id", readability(F.col("text")).alias("r")).select("doc_id", "r.*"))


QUERIES["text_readability"] = _readability
ORACLES["text_content_summary"] = f"""WITH {READS}, {TERMS}, st AS (SELECT doc_id, bool_or(stuffing) AS s FROM terms GROUP BY doc_id)
SELECT source AS crawl_id, count(*) AS pages, CAST(sum(words) AS BIGINT) AS words, CAST(round_even(CAST(avg(score) AS DOUBLE), 1) AS DOUBLE) AS mean_score, count(*) FILTER (words < 150) AS thin_pages, count(*) FILTER (coalesce(s, false)) AS stuffing_pages
FROM reads LEFT JOIN st USING (doc_id) GROUP BY source"""


@query(
    "text_rules",
    f"""WITH {READS}, {TERMS}, st AS (SELECT doc_id, bool_or(stuffing) AS s FROM terms GROUP BY doc_id), p AS (SELECT *, coalesce(s, false) AS stuffed FROM reads LEFT JOIN st USING (doc_id))
SELECT source AS crawl_id, doc_id AS page_id, 'KEYWORD_STUFFING' AS code, words >= 100 AND stuffed AS triggered, 'High' AS severity, 'Content' AS category, CAST(stuffed AS VARCHAR) AS actual FROM p
UNION ALL SELECT source, doc_id, 'CONTENT_LONG_SENTENCES', words >= 100 AND sentences >= 4 AND long_share > 30, 'Low', 'Content', format('{{:.1f}}', CAST(long_share AS DOUBLE)) FROM p
UNION ALL SELECT source, doc_id, 'THIN_CONTENT', words BETWEEN 1 AND 149, 'Medium', 'Content', CAST(words AS VARCHAR) FROM p""",
)
def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that read texts, on whole texts, with their evidence."""
    from ..functions.text import word_list

    wanted = [r for r in page_rules() if r.code in ("KEYWORD_STUFFING", "CONTENT_LONG_SENTENCES", "THIN_CONTENT")]
    pages = read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("page_id"), F.col("source").alias("crawl_id"), "text", F.size(word_list(F.coalesce("text", F.lit("")))).alias("word_count"), F.lit(200).alias("status"), F.lit(True).alias("is_indexable"), F.lit(True).alias("has_snapshot")
    )
    return evaluate_rules(pages, wanted).select("crawl_id", "page_id", "code", "triggered", "severity", "category", "evidence.actual")


@query(
    "text_hashes",
    f"""WITH n AS (SELECT doc_id, {_NORM} AS t FROM documents), w AS (SELECT doc_id, t, list_filter(string_split(t, ' '), lambda x: x <> '') AS w FROM n)
SELECT doc_id, upper(sha256(t)) AS hash, CASE WHEN len(w) < 3 THEN len(list_distinct(w)) ELSE len(list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)])) END AS shingles FROM w""",
)
def text_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "documents").select("doc_id", normalize_text(F.col("text")).alias("t"))
    return plain(rows.select("doc_id", content_hash(F.col("t")).alias("hash"), F.size(shingles(F.col("t"))).alias("shingles")))


@query(
    "text_similarity",
    f"""WITH n AS (SELECT doc_id, {_NORM} AS t FROM documents), w AS (SELECT doc_id, list_filter(string_split(t, ' '), lambda x: x <> '') AS w FROM n),
s AS (SELECT doc_id, CASE WHEN len(w) < 3 THEN list_distinct(w) ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) END AS s FROM w),
p AS (SELECT a.doc_id, len(list_intersect(a.s, b.s)) AS c, len(a.s) AS x, len(b.s) AS y FROM s a JOIN s b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, CASE WHEN x = 0 AND y = 0 THEN 1.0 WHEN x = 0 OR y = 0 THEN 0.0 ELSE round_even(c / (x + y - c), 4) END AS similarity FROM p""",
)
def text_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of each document and the one behind it; texts are normalised once, and travel as they are."""
    texts = read_table(spark, sf_dir, "documents").select("doc_id", normalize_text(F.col("text")).alias("s"))
    texts = Scratch(spark, "similarity").save(texts, "texts")
    after = texts.select((F.col("doc_id") - 1).alias("doc_id"), F.col("s").alias("t"))
    return plain(similarity(texts.join(after, "doc_id"), "doc_id", "s", "t"))


_CLUSTERS = f"""n AS (SELECT doc_id, coalesce({_NORM}, '') AS t FROM documents), h AS (SELECT t, min(doc_id) AS rep FROM n GROUP BY t),
w AS (SELECT rep, list_filter(string_split(t, ' '), lambda x: x <> '') AS w FROM h),
s AS (SELECT rep, CASE WHEN len(w) < 3 THEN list_distinct(w) ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) END AS s FROM w),
u AS (SELECT rep, unnest(s) AS g FROM s), c AS (SELECT x.rep AS a, y.rep AS b, count(*) AS c FROM u x JOIN u y USING (g) WHERE x.rep < y.rep GROUP BY ALL),
q AS (SELECT a, b, round_even(c / (len(x.s) + len(y.s) - c), 4) AS s FROM c JOIN s x ON x.rep = a JOIN s y ON y.rep = b), e AS (SELECT a, b FROM q WHERE s >= 0.85 UNION ALL SELECT b, a FROM q WHERE s >= 0.85),
r AS (SELECT rep AS node, rep AS root FROM h UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node), k AS (SELECT node, min(root) AS cluster FROM r GROUP BY node),
low AS (SELECT x.cluster, min(coalesce(q.s, 0)) AS s FROM k x JOIN k y ON x.cluster = y.cluster AND x.node < y.node LEFT JOIN q ON q.a = x.node AND q.b = y.node GROUP BY x.cluster),
clusters AS (SELECT cluster, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids, CAST(coalesce(min(low.s), 1) AS DOUBLE) AS similarity, coalesce(min(low.s), 1) = 1 AS exact
  FROM n JOIN h USING (t) JOIN k ON node = rep LEFT JOIN low USING (cluster) GROUP BY cluster HAVING count(*) > 1)"""
ORACLES["text_duplicate_clusters"] = f"WITH RECURSIVE {_CLUSTERS} SELECT * FROM clusters"


@query(
    "text_duplicate_issues",
    f"WITH RECURSIVE {_CLUSTERS} SELECT cluster AS page_id, CASE WHEN exact THEN 'DUPLICATE_CONTENT' ELSE 'NEAR_DUPLICATE_CONTENT' END AS code, 'Medium' AS severity, 'Content' AS category, replace(ids, ',', ', ') AS detail FROM clusters",
)
def text_duplicate_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_issues(duplicate_clusters(read_table(spark, sf_dir, "documents")))


# Page evidence


@query(
    "page_flags",
    f"""WITH {ctes("v_page")} SELECT page_id, status = 200 AND page_id % 10 <> 4 AND page_id % 13 <> 5 AS indexable, contains(regexp_replace(url, '^[^?]*', ''), '*') OR contains(lower(regexp_replace(url, '^[^?]*', '')), '%2a') AS wildcard,
  regexp_matches(trim(h1), '[?؟]$') OR lower(string_split(trim(h1), ' ')[1]) IN ('what', 'how', 'why', 'when', 'where', 'who', 'which', 'is', 'are', 'can', 'do', 'does', 'should') AS asks FROM v_page""",
)
def page_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "v_page")
    heading = F.array(F.struct(F.lit(1).alias("level"), F.col("h1").alias("text")))
    return p.select("page_id", is_indexable(F.col("status"), F.col("robots_meta"), F.col("x_robots")).alias("indexable"), is_wildcard_query(F.col("url")).alias("wildcard"), question_heading(heading).alias("asks"))


@query(
    "page_data_types",
    f"""WITH {ctes("v_page")} SELECT page_id, CASE ld_kind WHEN 3 THEN 'NewsArticle' WHEN 4 THEN 'Product' WHEN 5 THEN 'BreadcrumbList' WHEN 6 THEN 'Organization' WHEN 7 THEN 'FAQPage' ELSE '' END AS types,
  false AS dated, ld_kind <> 1 AS valid FROM v_page""",
)
def page_data_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(rule_pages(spark, sf_dir).select("page_id", structured_data(F.col("json_ld")).alias("d")).select("page_id", "d.*"))


@query(
    "page_titles_extracted",
    "SELECT page_id, " + ", ".join(markup_text(f"regexp_extract(html, '<{t}>(.*?)</{t}>', 1, 's')") + f" AS {t}" for t in ("title", "h1")) + " FROM pages",
)
def page_titles_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_pages(read_table(spark, sf_dir, "pages"))
    return found.select("page_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("h1", F.lit("")).alias("h1"))


def extracted_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pages as page evidence: html to snapshot, joined with what a fetch tells (status, headers, time), ready for the rules."""
    found = extract_pages(read_table(spark, sf_dir, "pages"))
    snapshot = found.withColumn("snapshot_id", F.col("page_id")).drop("url", "links")
    fetched = view(spark, sf_dir, "v_page").select("crawl_id", "project_id", "page_id", "url", "status", "response_ms", "depth", "content_type", "x_robots", "hops")
    pages = evidence.page_evidence(fetched, snapshot)
    return pages.withColumns(
        {
            "is_indexable": is_indexable(F.col("status"), F.col("robots_meta"), F.col("x_robots")),
            "headers": F.create_map(F.lit("Content-Type"), F.array(F.col("content_type"))),
            "redirects": F.array_repeat(F.lit("h"), F.col("hops").cast("int")),
        }
    )


@query(
    "site_issue_texts",
    f"WITH {rule_ctes()}, t(code, title) AS (VALUES {', '.join(f"('{c}', '{t}')" for c, t in TITLES.items())})\n"
    f"SELECT crawl_id, page_id, code, coalesce(title, replace(code, '_', ' ')) AS title, replace('{DESCRIPTION}', '{{code}}', code) AS description FROM results LEFT JOIN t USING (code) WHERE triggered",
)
def site_issue_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_texts(issues(evaluate_rules(rule_pages(spark, sf_dir)))).select("crawl_id", "page_id", "code", "title", "description")


@query(
    "page_assets_by_type",
    f"""WITH {ctes("v_page")} SELECT crawl_id, page_id, 'Script' AS type, false AS mixed, n_scripts AS n FROM v_page WHERE n_scripts > 0
UNION ALL SELECT crawl_id, page_id, 'Image', false, n_images FROM v_page WHERE n_images > 0 UNION ALL SELECT crawl_id, page_id, 'Iframe', true, 1 FROM v_page WHERE page_id % 4 = 2""",
)
def page_assets_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = rule_pages(spark, sf_dir)
    rows = audit.assets(pages, "Script").unionByName(audit.assets(pages, "Image")).unionByName(audit.assets(pages, mixed_only=True))
    return rows.groupBy("crawl_id", "page_id", "type", "mixed").agg(F.count(F.lit(1)).alias("n"))


@query("evidence_first_snapshot", "SELECT p_partkey AS page_id, min(l_orderkey * 10 + l_linenumber) AS snapshot_id, arg_min_null(l_returnflag, (l_orderkey * 10 + l_linenumber, coalesce(l_returnflag, ''))) AS title, count(l_orderkey) > 0 AS has_snapshot FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey")
def evidence_first_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = read_table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("page_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("snapshot_id"), F.col("l_returnflag").alias("title"))
    return evidence.page_evidence(read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id")), taken).select("page_id", "snapshot_id", "title", "has_snapshot")


_RAW = "SELECT o_orderkey AS page_id, o_custkey % 4 AS crawl_id, concat('https://', CASE o_orderkey % 5 WHEN 0 THEN 'other.example' WHEN 1 THEN 'www.shop.example' ELSE 'shop.example' END, '/', CAST(o_custkey % 50 AS STRING)) AS final_url, 'shop.example' AS project_host, o_orderkey % 7 <> 0 AS allowed, o_orderkey % 6 AS depth"


@query("evidence_final_urls", f"WITH r AS ({_RAW} FROM orders) SELECT page_id, crawl_id, final_url, depth FROM r WHERE allowed AND final_url NOT LIKE '%other.example%' QUALIFY row_number() OVER (PARTITION BY crawl_id, final_url ORDER BY depth, page_id) = 1")
def evidence_final_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.sql(_RAW + " FROM {orders}", orders=read_table(spark, sf_dir, "orders"))
    return evidence.dedupe_final_urls(raw).select("page_id", "crawl_id", "final_url", "depth")


@query(
    "evidence_counters",
    """WITH d AS (SELECT l_orderkey % 8 AS crawl_id, count(*) AS discovered FROM lineitem GROUP BY 1), p AS (SELECT o_orderkey % 9 AS crawl_id, count(*) AS crawled, count(*) FILTER (o_orderstatus = 'F') AS errors FROM orders GROUP BY 1)
SELECT crawl_id, coalesce(discovered, 0) AS discovered, coalesce(crawled, 0) AS crawled, coalesce(errors, 0) AS errors FROM d FULL JOIN p USING (crawl_id)""",
)
def evidence_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read_table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 8).alias("crawl_id"))
    pages = read_table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 9).alias("crawl_id"), F.when(F.col("o_orderstatus") == "F", 404).otherwise(200).alias("status"))
    return evidence.crawl_counters(found, pages)


@query("link_targets", "WITH p AS (SELECT p_partkey AS page_id, concat('HTTPS://X.example/', CAST(p_partkey % 700 AS VARCHAR)) AS url FROM part), a AS (SELECT lower(url) AS k, min(page_id) AS target_id FROM p GROUP BY 1) SELECT l_partkey AS source_id, target_id, count(*) AS n FROM lineitem JOIN a ON a.k = concat('https://x.example/', CAST(l_suppkey AS VARCHAR)) GROUP BY ALL")
def link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("HTTPS://X.example/"), (F.col("p_partkey") % 700).cast("string")).alias("url"))
    links = read_table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("source_id"), F.concat(F.lit("https://x.example/"), F.col("l_suppkey").cast("string")).alias("target_url"))
    return resolve_links(pages, links).groupBy("source_id", "target_id").agg(F.count(F.lit(1)).alias("n"))


_LINKED = r"""a AS (
  SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS base, unnest(regexp_extract_all(html, '<a href="([^"]*)"[^>]*>([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href="([^"]*)"[^>]*>([^<]*)</a>', 2)) AS text FROM pages
), l AS (
  SELECT page_id AS source_id, lower(base) || regexp_replace(replace(href, '&amp;', '&'), '/+$', '') AS normalized_target, replace(replace(replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS anchor FROM a WHERE starts_with(href, '/')
)"""
ORACLES["page_links"] = f"WITH {_LINKED} SELECT *, true AS is_internal, false AS is_nofollow FROM l"
ORACLES["page_discovery"] = f"""WITH {_LINKED}, k AS ({ORACLES["page_normalized_urls"]}), f AS (SELECT DISTINCT source_id % 4 AS crawl_id, normalized_target AS normalized_url FROM l)
SELECT crawl_id, normalized_url, CAST(1 AS INTEGER) AS depth FROM f WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.page_id % 4 = f.crawl_id AND k.normalized_url = f.normalized_url)"""


# Robots

_ROBOTS = """SELECT concat('s', CAST(s_suppkey AS STRING), '.example') AS host, s_suppkey, s_nationkey,
  concat('User-agent: *', chr(10), 'Disallow: /private/', CAST(s_nationkey AS STRING), chr(10), 'Crawl-delay: ', CAST(s_suppkey % 7 AS STRING), chr(10), chr(10), '# second', chr(10), 'User-Agent: Bot', CAST(s_suppkey % 3 AS STRING), chr(10),
         'Allow: /private/', CAST(s_nationkey AS STRING), '/open', chr(10), 'Disallow: /', chr(10), 'Sitemap: https://s', CAST(s_suppkey AS STRING), '.example/map.xml', chr(10), 'Clean-param: ref /', CAST(s_nationkey AS STRING)) AS body,
  CASE s_suppkey % 5 WHEN 0 THEN 200 WHEN 1 THEN 401 WHEN 2 THEN 503 WHEN 3 THEN 404 END AS status"""


def _robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_ROBOTS + " FROM {supplier}", supplier=read_table(spark, sf_dir, "supplier"))


@query(
    "robots_rule_table",
    f"""WITH r AS ({_ROBOTS} FROM supplier) SELECT host, '*' AS agent, false AS allow, concat('/private/', s_nationkey) AS pattern, CAST(s_suppkey % 7 AS DOUBLE) AS delay FROM r
UNION ALL SELECT host, concat('bot', s_suppkey % 3), true, concat('/private/', s_nationkey, '/open'), NULL FROM r UNION ALL SELECT host, concat('bot', s_suppkey % 3), false, '/', NULL FROM r""",
)
def robots_rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robots.robots_rules(_robots(spark, sf_dir)).select("host", "agent", "allow", "pattern", "delay")


_ASKED = "SELECT host, s_suppkey, s_nationkey, a.user_agent, concat('https://', host, '/', a.p, CASE WHEN a.n THEN CAST(s_nationkey AS STRING) ELSE '' END, a.q) AS url, a.p, a.q FROM r CROSS JOIN (VALUES ('MyBot1/2.0', 'private/', true, '/open/x'), ('MyBot1/2.0', 'shop', false, ''), ('Other', 'private/', true, '/a?b=c'), ('Other', 'shop', false, '')) AS a(user_agent, p, n, q)"
_DECIDED = "CASE WHEN user_agent = 'MyBot1/2.0' AND s_suppkey % 3 = 1 THEN p = 'private/' ELSE p = 'shop' END"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_ASKED.replace(" FROM r ", " FROM {r} "), r=_robots(spark, sf_dir)).select("host", "user_agent", "url")


@query("robots_decisions", f"WITH r AS ({_ROBOTS} FROM supplier), u AS ({_ASKED}) SELECT host, user_agent, url, {_DECIDED} AS allowed FROM u")
def robots_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robots.robots_allowed(_asked(spark, sf_dir), robots.robots_rules(_robots(spark, sf_dir)))


@query(
    "robots_policy_decisions",
    f"WITH r AS ({_ROBOTS} FROM supplier), u AS ({_ASKED}) SELECT host, user_agent, url, CASE s_suppkey % 5 WHEN 0 THEN {_DECIDED} WHEN 3 THEN true ELSE false END AS allowed FROM u",
)
def robots_policy_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    policies = robots.robots_policy(_robots(spark, sf_dir))
    rules = robots.robots_rules(policies.filter("policy = 'parse'"))
    return robots.robots_allowed(_asked(spark, sf_dir), rules, policies)


@query("robots_delays", f"WITH r AS ({_ROBOTS} FROM supplier), u AS (SELECT DISTINCT host, s_suppkey, user_agent FROM ({_ASKED})) SELECT host, user_agent, CASE WHEN user_agent = 'MyBot1/2.0' AND s_suppkey % 3 = 1 THEN NULL ELSE CAST(s_suppkey % 7 AS DOUBLE) END AS delay FROM u")
def robots_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robots.crawl_delay(_asked(spark, sf_dir), robots.robots_rules(_robots(spark, sf_dir)))


@query("robots_policies", f"WITH r AS ({_ROBOTS} FROM supplier) SELECT host, CASE s_suppkey % 5 WHEN 0 THEN 'parse' WHEN 1 THEN 'disallow_all' WHEN 3 THEN 'allow_all' ELSE 'unavailable' END AS policy FROM r")
def robots_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robots.robots_policy(_robots(spark, sf_dir)).select("host", "policy")


@query("robots_extras", f"WITH r AS ({_ROBOTS} FROM supplier) SELECT host, concat('https://', host, '/map.xml') AS sitemap, concat('ref /', s_nationkey) AS clean_param FROM r")
def robots_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _robots(spark, sf_dir)
    return robots.robots_sitemaps(rows).join(robots.robots_clean_params(rows), "host")


# Records of projects and crawls

_CRAWL = "SELECT o_orderkey AS crawl_id, o_custkey AS project_id, CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Running' ELSE 'Queued' END AS status, o_orderdate AS created_at, CAST(o_orderkey * 37 % 1001 AS DOUBLE) / 10 AS overall"
_KEYS = "SELECT l_orderkey AS crawl_id, l_linenumber AS n, concat(CASE WHEN l_linenumber % 2 = 0 THEN 'analyze:' ELSE 'crawl:' END, CAST(l_orderkey AS STRING), ':', CAST(l_linenumber AS STRING)) AS idempotency_key, CASE l_suppkey % 3 WHEN 0 THEN 'Pending' WHEN 1 THEN 'Failed' ELSE 'Running' END AS status, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + l_suppkey AS created_at"
_ISSUE = "SELECT l_orderkey * 10 + l_linenumber AS issue_id, l_suppkey % 50 AS project_id, l_orderkey AS crawl_id, CASE l_returnflag WHEN 'A' THEN 82 WHEN 'N' THEN 65 ELSE 40 END AS priority, CASE l_returnflag WHEN 'A' THEN 'Critical' ELSE 'Low' END AS severity, l_shipdate AS created_at, CASE l_linestatus WHEN 'F' THEN 'Open' ELSE 'Done' END AS status"


def _rows(spark: SparkSession, sf_dir: str, sql: str, table: str) -> DataFrame:
    return spark.sql(f"{sql} FROM {{{table}}}", **{table: read_table(spark, sf_dir, table)})


@query("score_history", f"WITH s AS ({_CRAWL} FROM orders) SELECT project_id, crawl_id, overall, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, crawl_id DESC) AS rank FROM s QUALIFY rank <= 100")
def score_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(audit.score_history(_rows(spark, sf_dir, _CRAWL, "orders")).select("project_id", "crawl_id", "overall", "rank"))


@query("score_latest", f"WITH s AS ({_CRAWL} FROM orders) SELECT project_id, crawl_id, overall FROM s QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, crawl_id DESC) = 1")
def score_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.latest_score(_rows(spark, sf_dir, _CRAWL, "orders")).select("project_id", "crawl_id", "overall")


@query("recommendation_list", f"WITH r AS ({_ISSUE} FROM lineitem) SELECT project_id, issue_id, priority, row_number() OVER (PARTITION BY project_id ORDER BY priority DESC, created_at DESC, issue_id) AS rank FROM r WHERE status = 'Open' AND issue_id IN (SELECT issue_id FROM r WHERE severity = 'Low')")
def recommendation_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, _ISSUE, "lineitem")
    return plain(audit.recommendation_list(rows, rows.filter("severity = 'Low'"), "Open").select("project_id", "issue_id", "priority", "rank"))


@query("crawl_list", f"WITH c AS ({_CRAWL} FROM orders) SELECT project_id, crawl_id, status, CASE WHEN crawl_id % 3 = 0 THEN 'Failed' END AS analysis_status, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, crawl_id DESC) AS rank FROM c")
def crawl_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    crawls = _rows(spark, sf_dir, _CRAWL, "orders")
    return plain(audit.crawl_list(crawls, crawls.filter("crawl_id % 3 = 0").select("crawl_id", F.lit("Failed").alias("status"))).select("project_id", "crawl_id", "status", "analysis_status", "rank"))


@query(
    "analysis_status",
    f"""WITH c AS ({_CRAWL} FROM orders), j AS ({_KEYS} FROM lineitem), k AS (SELECT crawl_id, arg_max(status, created_at) AS job_status FROM j WHERE n % 2 = 0 GROUP BY crawl_id), i AS ({_ISSUE} FROM lineitem),
g AS (SELECT crawl_id, count(*) AS issues, count(*) FILTER (severity = 'Critical') AS critical FROM i GROUP BY crawl_id)
SELECT CAST(crawl_id AS VARCHAR) AS crawl_id, status AS crawl_status, CASE WHEN crawl_id % 3 = 0 THEN 'Failed' END AS analysis_status, job_status, crawl_id % 5 = 0 AS has_score, coalesce(issues, 0) AS issues, coalesce(critical, 0) AS critical,
  status = 'Completed' AND crawl_id % 3 = 0 AND coalesce(job_status, '') NOT IN ('Pending', 'Running') AS retryable FROM c LEFT JOIN k USING (crawl_id) LEFT JOIN g USING (crawl_id)""",
)
def analysis_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    crawls = _rows(spark, sf_dir, _CRAWL, "orders")
    failed = crawls.filter("crawl_id % 3 = 0").select("crawl_id", F.lit("Failed").alias("status"))
    return plain(audit.analysis_status(crawls, failed, _rows(spark, sf_dir, _KEYS, "lineitem"), crawls.filter("crawl_id % 5 = 0"), _rows(spark, sf_dir, _ISSUE, "lineitem")))


@query(
    "stalled_crawls",
    f"WITH c AS ({_CRAWL} FROM orders), j AS ({_KEYS} FROM lineitem) SELECT CAST(crawl_id AS VARCHAR) AS crawl_id, status FROM c WHERE status IN ('Queued', 'Running') AND crawl_id NOT IN (SELECT crawl_id FROM j WHERE n % 2 = 1 AND status IN ('Pending', 'Running'))",
)
def stalled_crawls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.stalled_crawls(_rows(spark, sf_dir, _CRAWL, "orders"), _rows(spark, sf_dir, _KEYS, "lineitem")).select("crawl_id", "status")


@query("audit_log", "SELECT user_id AS project_id, event_id AS id, event_type AS action, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events QUALIFY rank <= 200")
def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("project_id"), F.col("event_id").alias("id"), F.col("event_type").alias("action"), F.col("ts").alias("created_at"))
    return plain(audit.audit_log_list(log).select("project_id", "id", "action", "rank"))


@query("member_list", "SELECT o_orderkey AS project_id, o_custkey AS user_id, c_name AS name, lower(c_name) AS email FROM orders JOIN customer ON c_custkey = o_custkey")
def member_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("project_id"), F.col("o_custkey").alias("user_id"))
    users = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.lower("c_name").alias("email"), F.col("c_name").alias("name"))
    return audit.member_list(members, users).select("project_id", "user_id", "name", "email")


_FIGURES = """SELECT o_custkey AS crawl_id, CASE WHEN o_custkey % 11 = 0 THEN 0 ELSE count(*) END AS pages, count(*) - o_custkey % 2 * (count(*) // 2) AS indexable, o_custkey % 700 + 0.5 AS mean_ms, count(*) % 3 AS errors,
  CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_custkey % 2 END AS orphans, o_custkey % 3 AS dead_ends, CASE WHEN o_custkey % 11 = 0 THEN 0 ELSE count(*) % 4 END AS thin_pages, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE 0 END AS stuffing_pages,
  CASE WHEN o_custkey % 7 = 1 THEN 2 ELSE 0 END AS duplicate_titles, 0 AS critical, 1 AS high, o_custkey % 6 AS tracked_keywords, CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE o_custkey % 2 END AS active_competitors"""


@query(
    "evidence_summary",
    f"""WITH f AS ({_FIGURES} FROM orders GROUP BY o_custkey), t(k, metric, observation, cause, recommendation, action) AS (VALUES
  (1, 'errors', 'pages answer with an error', 'Broken or moved addresses', 'Repair the errors and the links to them', 'Go through the failing addresses and redirect them'),
  (2, 'orphans', 'pages have no internal link to them', 'New pages missing in navigation', 'Link them from pages of high authority', 'Add them to navigation and to related pages'),
  (3, 'dead_ends', 'pages link nowhere', NULL, 'Add related content at their end', 'Put related links and breadcrumbs on them'),
  (4, 'thin_pages', 'pages hold little text', 'Pages published unfinished', 'Extend them or keep them out of the index', 'Complete the most visited ones first'),
  (5, 'stuffing_pages', 'pages repeat a term too often', 'Over-optimised text', 'Vary the wording', 'Rewrite the repeated passages'),
  (6, 'duplicate_titles', 'pages share a title', 'Several pages aim at one phrase', 'Merge them or name a canonical page', 'Choose the main page and retitle the others')
), m AS (
  SELECT crawl_id, k, metric, observation, cause, recommendation, action, CASE k WHEN 1 THEN errors WHEN 2 THEN orphans WHEN 3 THEN dead_ends WHEN 4 THEN thin_pages WHEN 5 THEN stuffing_pages ELSE duplicate_titles END AS value FROM f, t
), g AS (
  SELECT crawl_id, string_agg(value || ' ' || observation, '|' ORDER BY k) AS o, string_agg(cause, '|' ORDER BY k) AS c, string_agg(recommendation, '|' ORDER BY k) AS r, string_agg(action, '|' ORDER BY k) AS a,
         string_agg(metric || '=' || value, '|' ORDER BY k) AS findings FROM m WHERE value > 0 GROUP BY crawl_id
)
SELECT crawl_id,
  coalesce(concat_ws('|', CASE WHEN pages > 0 THEN pages || ' pages, ' || indexable || ' of them indexable ( ' || CAST(round_even(CAST(indexable * 100 AS DECIMAL(18,8)) / pages, 1) AS DECIMAL(4,1)) || ' %), mean time ' || CAST(floor(mean_ms) AS BIGINT) || ' ms' END, o,
    CASE WHEN pages = 0 AND o IS NULL THEN 'The crawl shows no change to report' END), '') AS observations,
  coalesce(c, 'Gradual changes without a regular audit') AS causes, coalesce(r, CASE WHEN pages = 0 THEN 'Keep watching and write about new keywords' ELSE '' END) AS recommendations,
  coalesce(a, CASE WHEN pages = 0 THEN 'Check once a month and compare with competitors' ELSE '' END) AS actions,
  concat_ws('|', CASE WHEN tracked_keywords = 0 THEN 'No keyword is tracked' END, CASE WHEN active_competitors = 0 THEN 'No competitor is active' END) AS missing, coalesce(findings, '') AS findings
FROM f LEFT JOIN g USING (crawl_id)""",
)
def evidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    figures = spark.sql((_FIGURES + " FROM {orders} GROUP BY o_custkey").replace("//", "DIV"), orders=read_table(spark, sf_dir, "orders"))
    found = audit.evidence_summary(figures)
    texts = [F.array_join(c, "|").alias(c) for c in ("observations", "causes", "recommendations", "actions", "missing")]
    return found.select("crawl_id", *texts, F.array_join(F.transform("findings", lambda x: F.concat_ws("=", x["metric"], x["value"].cast("string"))), "|").alias("findings"))


@query("evidence_overview")
def evidence_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each crawl with all figures and the hash of them."""
    from ..operators.links import duplicate_titles, link_graph

    pages = rule_pages(spark, sf_dir)
    nodes = pages.select("page_id", (F.col("depth") == 0).alias("is_root"), F.lit(True).alias("in_seeds"))
    content = audit.content_analysis(pages.join(read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.col("text").alias("body")), "page_id", "left").withColumn("text", F.col("body")))
    keyword, rival = view(spark, sf_dir, "v_keyword"), spark.range(4).select(F.col("id").alias("project_id"), F.lit(True).alias("is_active"))
    return plain(audit.evidence_overview(pages, link_graph(nodes, view(spark, sf_dir, "v_link")), content, duplicate_titles(pages), issues(evaluate_rules(pages)), keyword, rival).drop("top_issues"))


# Reports and written tables


@query(
    "report_rows",
    f"""WITH i AS ({_ISSUE} FROM lineitem), c AS ({_CRAWL} FROM orders) SELECT crawl_id, i.issue_id AS page_id, severity, c.project_id, c.overall FROM i JOIN c USING (crawl_id)""",
)
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report written as CSV and read again."""
    crawls = _rows(spark, sf_dir, _CRAWL, "orders")
    found = _rows(spark, sf_dir, _ISSUE, "lineitem").select("crawl_id", F.col("issue_id").alias("page_id"), "severity", F.lit("X").alias("code"))
    path = fresh_path(spark, "report")
    write_report(report(crawls.select("crawl_id", "project_id"), crawls.select("crawl_id", "overall"), found), path, "csv")
    back = spark.read.option("header", True).schema("crawl_id bigint, page_id bigint, severity string, code string, project_id bigint, overall double").csv(path)
    return back.drop("code")


@query("report_cells", "SELECT p_partkey, replace(concat(['=', '+', '-', '@', '', '\"'][p_partkey % 6 + 1], p_name), '\"', '\"\"') AS raw, CASE WHEN p_partkey % 6 < 4 THEN '''' ELSE '' END || replace(concat(['=', '+', '-', '@', '', '\"'][p_partkey % 6 + 1], p_name), '\"', '\"\"') AS cell FROM part")
def report_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.element_at(F.array(*[F.lit(x) for x in ("=", "+", "-", "@", "", '"')]), (F.col("p_partkey") % 6 + 1).cast("int"))
    rows = read_table(spark, sf_dir, "part").select("p_partkey", F.concat(mark, F.col("p_name")).alias("v"))
    return rows.select("p_partkey", F.replace("v", F.lit('"'), F.lit('""')).alias("raw"), csv_safe(F.col("v")).alias("cell"))


@query("report_list", "SELECT o_custkey AS project_id, o_orderkey AS id FROM orders")
def report_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports_list(read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"))).select("project_id", "id")


@query(
    "written_issues",
    """WITH i AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey % 6 AS crawl_id, CASE WHEN l_linenumber % 3 = 0 THEN 'advisory' ELSE 'rule' END AS source, l_returnflag FROM lineitem)
SELECT id, crawl_id, source, 1 AS run FROM i WHERE crawl_id NOT IN (1, 2) OR source = 'advisory' UNION ALL SELECT id, crawl_id, source, 2 FROM i WHERE crawl_id = 1 AND source = 'rule' AND l_returnflag = 'R'""",
)
def written_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs: the second replaces the rule findings of crawl 1 and finds none in crawl 2; advisories stay."""
    rows = read_table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_suppkey") % 6).alias("crawl_id"), F.when(F.col("l_linenumber") % 3 == 0, "advisory").otherwise("rule").alias("source"), "l_returnflag"
    )
    path = fresh_path(spark, "issues")
    write_crawl_rows(rows.withColumn("run", F.lit(1).cast("bigint")), path, [0, 1, 2, 3, 4, 5], "source")
    again = rows.filter("crawl_id = 1 and source = 'rule' and l_returnflag = 'R'").withColumn("run", F.lit(2).cast("bigint"))
    write_crawl_rows(again, path, [1, 2], "source", spare=("source=advisory",))
    return spark.read.schema("id bigint, l_returnflag string, run bigint, crawl_id bigint, source string").parquet(path).select("id", "crawl_id", "source", "run")


@query("raw_pages_read", "SELECT url AS requested_url, length(html) AS size FROM pages")
def raw_pages_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "raw-pages")
    read_table(spark, sf_dir, "pages").select(F.lit("c").alias("crawl_id"), F.col("url").alias("requested_url"), "html").write.parquet(path)
    return read_raw_pages(spark, path).select("requested_url", F.length("html").cast("bigint").alias("size"))


@query(
    "search_metrics_ingest",
    """WITH r AS (SELECT concat('Phrase ', l_suppkey % 40) AS query, concat('/p/', l_partkey % 9) AS page_url, CAST(l_shipdate AS DATE) AS date, CAST(l_quantity AS INT) AS impressions, l_orderkey % 5 AS clicks FROM lineitem),
f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY query, date, page_url ORDER BY impressions DESC, clicks DESC) = 1)
SELECT lower(query) AS normalized_phrase, date, page_url, CAST(impressions AS BIGINT) AS impressions, CAST(clicks AS BIGINT) AS clicks, 'DE' AS country, 'ALL' AS device, NOT starts_with(query, 'Phrase 1') AS fresh FROM f""",
)
def search_metrics_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API answers of one row each; phrases that begin with ``phrase 1`` are known before."""
    line = read_table(spark, sf_dir, "lineitem")
    row = F.struct(
        F.array(F.concat(F.lit(" Phrase "), (F.col("l_suppkey") % 40).cast("string")), F.concat(F.lit("/p/"), (F.col("l_partkey") % 9).cast("string")), F.date_format("l_shipdate", "yyyy-MM-dd")).alias("keys"),
        (F.col("l_orderkey") % 5).cast("double").alias("clicks"), F.col("l_quantity").cast("int").cast("double").alias("impressions"), F.lit(0.5).alias("ctr"), F.lit(3.0).alias("position"),
    )
    raw = line.select(F.to_json(F.struct(F.array(row).alias("rows"))).alias("json"))
    phrases = spark.range(40).select(F.concat(F.lit("phrase "), F.col("id").cast("string")).alias("normalized_phrase")).filter("normalized_phrase like 'phrase 1%'")
    known = phrases.select(F.concat(F.lit("k-"), "normalized_phrase").alias("id"), F.lit("p").alias("project_id"), "normalized_phrase", F.lit("ALL").alias("country"))
    none = spark.createDataFrame([], "keyword_id string, date date, page_url string, country string, device string")
    fresh, made = ingest.ingest_search_metrics(raw, known, none, "p", "de")
    names = fresh.select(F.col("id").alias("keyword_id"), "normalized_phrase", F.lit(True).alias("fresh")).unionByName(known.select(F.col("id").alias("keyword_id"), "normalized_phrase", F.lit(False).alias("fresh")))
    return plain(made.join(names, "keyword_id").select("normalized_phrase", "date", "page_url", "impressions", "clicks", "country", "device", "fresh"))


@query("feed_states", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'NotConfigured' WHEN o_orderstatus = 'F' THEN 'Unavailable' WHEN o_orderkey % 3 = 0 THEN 'Partial' ELSE 'Available' END AS state FROM orders")
def feed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").select("o_orderkey", ingest.feed_state(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus") != "F", F.col("o_orderkey") % 3 != 0).alias("state"))


# Captures of results and backlinks

_CAPTURE = "SELECT o_orderkey AS snapshot_id, o_custkey AS keyword_id, CASE o_orderkey % 2 WHEN 0 THEN 'mobile' ELSE 'desktop' END AS device, o_orderstatus AS surface, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END AS captured_at, o_orderdate AS created_at, CASE o_orderkey % 4 WHEN 0 THEN 'Unavailable' WHEN 1 THEN 'Partial' ELSE 'Available' END AS availability, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 20 END AS own_position, o_custkey % 7 AS f"


@query("serp_latest", f"WITH s AS ({_CAPTURE} FROM orders) SELECT keyword_id, device, snapshot_id, row_number() OVER (PARTITION BY keyword_id, device ORDER BY created_at DESC, snapshot_id DESC) AS rank FROM s QUALIFY rank <= 3")
def serp_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(snapshots.newest(_rows(spark, sf_dir, _CAPTURE, "orders"), ["keyword_id", "device"], "created_at", 3).select("keyword_id", "device", "snapshot_id", "rank"))


@query("serp_pending", f"WITH s AS ({_CAPTURE} FROM orders) SELECT keyword_id, device, surface, snapshot_id FROM s WHERE captured_at IS NULL QUALIFY row_number() OVER (PARTITION BY keyword_id, device, surface ORDER BY created_at DESC, snapshot_id DESC) = 1")
def serp_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.serp_pending(_rows(spark, sf_dir, _CAPTURE, "orders")).select("keyword_id", "device", "surface", "snapshot_id")


_SIDES = "SELECT CAST(keyword_id * 2 AS BIGINT) AS snapshot_id, 'o' AS side, CASE WHEN keyword_id % 6 = 0 THEN 'Unavailable' ELSE 'Partial' END AS availability, CAST(keyword_id % 9 AS BIGINT) AS own_position, ['faq', 'map'] AS features FROM k UNION ALL SELECT CAST(keyword_id * 2 + 1 AS BIGINT), 'n', 'Available', CASE WHEN keyword_id % 4 = 0 THEN NULL ELSE CAST(5 AS BIGINT) END, ['map', 'video'] FROM k"


def _captures(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two captures of each keyword of ``v_serp``, their results, and the pairs of them."""
    v = view(spark, sf_dir, "v_serp")
    sql = _SIDES.replace("['faq', 'map']", "array('faq', 'map')").replace("['map', 'video']", "array('map', 'video')").replace(" FROM k", " FROM {k}")
    states = spark.sql(sql, k=v.select("keyword_id").distinct())
    old = v.filter("in_old").select((F.col("keyword_id") * 2).cast("bigint").alias("snapshot_id"), "url", F.col("old_rank").alias("position"))
    new = v.filter("in_new").select((F.col("keyword_id") * 2 + 1).cast("bigint").alias("snapshot_id"), "url", F.col("new_rank").alias("position"))
    pairs = v.select((F.col("keyword_id") * 2).cast("bigint").alias("from_id"), (F.col("keyword_id") * 2 + 1).cast("bigint").alias("to_id")).distinct()
    return states, old.unionByName(new), pairs


@query(
    "serp_change_totals",
    f"""WITH {ctes("v_serp")}, k AS (SELECT DISTINCT keyword_id FROM v_serp WHERE keyword_id % 6 <> 0)
SELECT CAST(keyword_id * 2 AS BIGINT) AS from_id, CAST(keyword_id * 2 + 1 AS BIGINT) AS to_id, CAST(keyword_id % 9 AS BIGINT) AS from_position, CASE WHEN keyword_id % 4 <> 0 THEN CAST(5 AS BIGINT) END AS to_position, CASE WHEN keyword_id % 4 <> 0 THEN CAST(keyword_id % 9 - 5 AS BIGINT) END AS position_delta,
  CASE WHEN keyword_id % 4 = 0 THEN 'unknown' WHEN keyword_id % 9 > 5 THEN 'improved' WHEN keyword_id % 9 < 5 THEN 'declined' ELSE 'unchanged' END AS movement, 'video' AS features_added, 'faq' AS features_removed FROM k""",
)
def serp_change_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(snapshots.serp_changes(*_captures(spark, sf_dir))[0])


@query(
    "serp_movements",
    f"""WITH {ctes("v_serp")}, a AS (SELECT keyword_id, regexp_replace(substr(url, 9), '/+$', '') AS key, old_rank FROM v_serp WHERE in_old), b AS (SELECT keyword_id, regexp_replace(substr(url, 9), '/+$', '') AS key, new_rank FROM v_serp WHERE in_new),
m AS (SELECT keyword_id, key, old_rank, new_rank, old_rank - new_rank AS delta FROM a FULL JOIN b USING (keyword_id, key) WHERE keyword_id % 6 <> 0)
SELECT CAST(keyword_id * 2 AS BIGINT) AS from_id, CAST(keyword_id * 2 + 1 AS BIGINT) AS to_id, key, old_rank AS old_position, new_rank AS new_position, delta,
  CASE WHEN old_rank IS NULL THEN 'entered' WHEN new_rank IS NULL THEN 'dropped' WHEN delta > 0 THEN 'improved' WHEN delta < 0 THEN 'declined' ELSE 'unchanged' END AS kind,
  row_number() OVER (PARTITION BY keyword_id ORDER BY abs(coalesce(delta, 0)) DESC, coalesce(new_rank, old_rank), key) AS rank FROM m""",
)
def serp_movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(snapshots.serp_changes(*_captures(spark, sf_dir))[1])


_SEEN = "SELECT l_suppkey % 30 AS snapshot_id, concat('http://S', CAST(l_partkey % 40 AS STRING), '.example/', CAST(l_linenumber AS STRING)) AS source_url, concat('/T', CAST(l_orderkey % 5 AS STRING)) AS target_url, l_linenumber % 2 = 0 AS is_new"
_TOTALS = "SELECT n AS snapshot_id, CASE n % 4 WHEN 0 THEN 'Unavailable' ELSE 'Available' END AS availability, CASE WHEN n % 5 <> 0 THEN n * n % 17 END AS referring_domains, n * 7 % 23 AS total_backlinks"


def _backlinks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    seen = _rows(spark, sf_dir, _SEEN, "lineitem").distinct()
    states = spark.sql(_TOTALS + " FROM {s}", s=seen.select(F.col("snapshot_id").alias("n")).distinct())
    return states, seen, states.select(F.col("snapshot_id").alias("from_id"), (F.col("snapshot_id") + 1).alias("to_id"))


@query("backlink_change_totals", f"WITH s AS (SELECT DISTINCT l_suppkey % 30 AS n FROM lineitem), t AS ({_TOTALS} FROM s) SELECT a.snapshot_id AS from_id, b.snapshot_id AS to_id, b.referring_domains - a.referring_domains AS referring_domains_delta, b.total_backlinks - a.total_backlinks AS total_backlinks_delta FROM t a JOIN t b ON b.snapshot_id = a.snapshot_id + 1 WHERE a.availability <> 'Unavailable' AND b.availability <> 'Unavailable'")
def backlink_change_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(snapshots.backlink_changes(*_backlinks(spark, sf_dir))[0])


@query(
    "backlink_change_links",
    f"""WITH o AS (SELECT DISTINCT snapshot_id, lower(source_url || '|' || target_url) AS key FROM ({_SEEN} FROM lineitem)), p AS (SELECT DISTINCT a.snapshot_id AS f, b.snapshot_id AS t FROM o a JOIN o b ON b.snapshot_id = a.snapshot_id + 1 WHERE a.snapshot_id % 4 <> 0 AND b.snapshot_id % 4 <> 0)
SELECT f AS from_id, t AS to_id, key, 'added' AS change FROM p JOIN o ON snapshot_id = t WHERE NOT EXISTS (SELECT 1 FROM o x WHERE x.snapshot_id = f AND x.key = o.key)
UNION ALL SELECT f, t, key, 'removed' FROM p JOIN o ON snapshot_id = f WHERE NOT EXISTS (SELECT 1 FROM o x WHERE x.snapshot_id = t AND x.key = o.key)""",
)
def backlink_change_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.backlink_changes(*_backlinks(spark, sf_dir))[1]


@query(
    "backlink_listing",
    f"WITH o AS (SELECT DISTINCT * FROM ({_SEEN} FROM lineitem)) SELECT snapshot_id, source_url, target_url, is_new, count(*) OVER (PARTITION BY snapshot_id) > 500 AS truncated, row_number() OVER (PARTITION BY snapshot_id ORDER BY is_new DESC, lower(regexp_extract(source_url, '//([^/]+)/', 1)), source_url, target_url) AS rank FROM o WHERE snapshot_id % 4 <> 0 QUALIFY rank <= 500",
)
def backlink_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    states, seen, _ = _backlinks(spark, sf_dir)
    return plain(snapshots.backlink_observations(states, seen).select("snapshot_id", "source_url", "target_url", "is_new", "truncated", "rank"))


@query("competitor_crawl_list", f"WITH {ctes('v_rival')} SELECT DISTINCT competitor_id, crawl_id, CAST(dense_rank() OVER (PARTITION BY competitor_id ORDER BY created_at DESC, crawl_id DESC) AS BIGINT) AS rank FROM v_rival QUALIFY rank <= 20")
def competitor_crawl_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    crawls = view(spark, sf_dir, "v_rival").select("competitor_id", "crawl_id", "created_at").distinct()
    return plain(competitors.competitor_crawls(crawls).select("competitor_id", "crawl_id", "rank"))


# Visibility: the robots files of suppliers name a crawler for some hosts, let all in or keep all out for others

_AI = """SELECT s_suppkey AS crawl_id, concat('s', CAST(s_suppkey AS STRING), '.example') AS host, s_suppkey % 6 <> 5 AS has_robots,
  CASE s_suppkey % 6 WHEN 0 THEN concat('User-agent: *', chr(10), 'Disallow: /') WHEN 1 THEN concat('User-agent: GPTBot', chr(10), 'Disallow: /') WHEN 2 THEN concat('User-agent: gptbot', chr(10), 'Allow: /') WHEN 3 THEN concat('User-agent: *', chr(10), 'Disallow: /x') ELSE '' END AS body"""
_PROFILE_SQL = ", ".join(f"('{k}', '{a}', CAST({w} AS DECIMAL(5,4)))" for k, a, _, w in visibility.PROFILES)
_ACCESS = f"""h AS ({_AI} FROM supplier), c(key, user_agent, weight) AS (VALUES {_PROFILE_SQL}), access AS (
  SELECT crawl_id, host, key, user_agent, weight, CASE crawl_id % 6 WHEN 5 THEN 'Unknown' WHEN 0 THEN 'Blocked' WHEN 1 THEN CASE WHEN key = 'gptbot' THEN 'Blocked' ELSE 'Unspecified' END WHEN 2 THEN CASE WHEN key = 'gptbot' THEN 'Allowed' ELSE 'Unspecified' END ELSE 'Unspecified' END AS access FROM h, c
)"""


def _access(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = spark.sql(_AI + " FROM {supplier}", supplier=read_table(spark, sf_dir, "supplier"))
    found = visibility.ai_crawler_access(hosts, robots.robots_rules(hosts.filter("has_robots")), visibility.profiles(spark))
    return found.join(hosts.select("host", "crawl_id"), "host")


@query("visibility_access", f"WITH {_ACCESS} SELECT host, key, user_agent, CAST(weight AS DOUBLE) AS weight, access FROM access")
def visibility_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(_access(spark, sf_dir).select("host", "key", "user_agent", "weight", "access"))


_CRAWLABLE = "SELECT crawl_id, round_even(CAST(sum(weight * CASE access WHEN 'Allowed' THEN 100 WHEN 'Unspecified' THEN 70 WHEN 'Blocked' THEN 0 END) AS DOUBLE) / CAST(sum(CASE WHEN access <> 'Unknown' THEN weight END) AS DOUBLE), 1) AS crawlability FROM access GROUP BY crawl_id"


@query("visibility_crawlability", f"WITH {_ACCESS} {_CRAWLABLE}")
def visibility_crawlability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(visibility.ai_crawlability(_access(spark, sf_dir), "crawl_id"))


_SIGNALS = "SELECT s_suppkey AS crawl_id, s_suppkey % 5 AS pages, s_suppkey % 2 AS n_question, 0 AS n_faq, s_suppkey % 3 AS n_concise, 1 AS n_structure, s_suppkey % 4 AS n_schema, 0 AS n_entity, 1 AS n_canonical, 0 AS n_author, s_suppkey % 5 AS n_evaluable"


@query(
    "visibility_advisories",
    f"""WITH {_ACCESS}, s AS ({_SIGNALS} FROM supplier) SELECT crawl_id, 'AEO_CRAWLERS_BLOCKED' AS code, 'Notice' AS severity, 'Indexability' AS category, string_agg(DISTINCT user_agent, ', ' ORDER BY user_agent) AS detail FROM access WHERE access = 'Blocked' GROUP BY crawl_id
UNION ALL SELECT crawl_id, 'AEO_ANSWER_STRUCTURE_MISSING', 'Notice', 'Content', CAST(pages AS VARCHAR) FROM s WHERE pages > 0 AND n_question = 0""",
)
def visibility_advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visibility.ai_advisories(_access(spark, sf_dir), _rows(spark, sf_dir, _SIGNALS, "supplier"))


@query(
    "visibility_sync",
    """WITH k AS (SELECT s_suppkey AS crawl_id, s_suppkey % 2 = 0 AS was, s_suppkey % 3 = 0 AS now, s_suppkey % 5 <> 0 AS judged, CASE s_suppkey % 4 WHEN 0 THEN 'Open' ELSE 'Ignored' END AS status FROM supplier)
SELECT crawl_id, 'A' AS code, CASE WHEN was THEN status ELSE 'Open' END AS status, CASE WHEN now THEN 'new' ELSE 'old' END AS detail FROM k WHERE (was OR now) AND NOT (was AND NOT now AND judged AND status = 'Open')""",
)
def visibility_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("crawl_id"), F.lit("A").alias("code"))
    old = k.filter("crawl_id % 2 = 0").withColumns({"status": F.when(F.col("crawl_id") % 4 == 0, "Open").otherwise("Ignored"), "detail": F.lit("old")})
    return visibility.sync_advisories(old, k.filter("crawl_id % 3 = 0").withColumn("detail", F.lit("new")), k.filter("crawl_id % 5 <> 0"))


_VISIBLE = f"""{_ACCESS}, s AS ({_SIGNALS} FROM supplier), cr AS ({_CRAWLABLE}), sc AS (
  SELECT crawl_id, CASE WHEN pages > 0 THEN round_even(n_question / pages * 30 + n_faq / pages * 20 + n_concise / pages * 20 + n_structure / pages * 30, 1) END AS answer,
    CASE WHEN pages > 0 THEN round_even(n_schema / pages * 30 + n_entity / pages * 30 + n_canonical / pages * 20 + n_author / pages * 20, 1) END AS citation, CASE WHEN pages > 0 THEN round_even(n_concise / pages * 100, 1) END AS accessibility FROM s
), v AS (SELECT crawl_id, crawlability, answer, citation, accessibility, round_even(crawlability * 0.4 + answer * 0.25 + citation * 0.25 + accessibility * 0.1 + 1e-9, 1) AS visibility FROM cr LEFT JOIN sc USING (crawl_id))"""


@query(
    "visibility_snapshot",
    f"""WITH {_VISIBLE}, n AS (SELECT crawl_id, count(*) FILTER (access = 'Allowed') AS allowed, count(*) FILTER (access = 'Blocked') AS blocked, count(*) FILTER (access = 'Unspecified') AS unspecified FROM access GROUP BY crawl_id)
SELECT crawl_id, crawlability, answer, citation, accessibility, allowed, blocked, unspecified, CAST(pages AS BIGINT) AS pages FROM v JOIN n USING (crawl_id) JOIN s USING (crawl_id)""",
)
def visibility_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    access, signals = _access(spark, sf_dir), _rows(spark, sf_dir, _SIGNALS, "supplier")
    found = visibility.ai_scores(signals, visibility.ai_crawlability(access, "crawl_id"))
    return plain(visibility.visibility_snapshot(access, signals, found).drop("visibility"))


# Owners and alerts


@query(
    "account_billing_owner",
    """WITH p AS (SELECT c_custkey AS project_id, c_nationkey AS owner_id FROM customer), m AS (SELECT o_orderkey % 60 AS user_id, min(owner_id) AS host FROM orders JOIN p ON project_id = o_custkey GROUP BY 1), u AS (SELECT CAST(range AS BIGINT) AS user_id FROM range(60))
SELECT user_id, CASE WHEN user_id IN (SELECT owner_id FROM p) THEN user_id ELSE coalesce(host, user_id) END AS owner_id FROM u LEFT JOIN m USING (user_id)""",
)
def account_billing_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    projects = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project_id"), F.col("c_nationkey").cast("bigint").alias("owner_id"))
    members = read_table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 60).alias("user_id"), F.col("o_custkey").alias("project_id"))
    return accounts.billing_owner(spark.range(60).withColumnRenamed("id", "user_id"), projects, members)


_RULE = "SELECT c_custkey * 10 + t.n AS rule_id, c_custkey AS project_id, t.type, t.threshold, c_custkey % 11 <> 0 AS is_enabled, CASE t.n % 3 WHEN 0 THEN 'webhook' WHEN 1 THEN 'email' ELSE 'dashboard' END AS channel, concat('to-', CAST(c_custkey AS STRING)) AS destination"
_TYPES = "(VALUES (1, 'SCORE_DROP', 10), (2, 'CRITICAL_ISSUE', 0), (3, 'CRAWL_FAILURE', 0), (4, 'CANNIBALIZATION_DETECTED', 0), (5, 'THIN_CONTENT_SPIKE', 2), (6, 'ORPHAN_PAGES_DETECTED', 1)) AS t(n, type, threshold)"
_STATE = "SELECT o_orderkey AS crawl_id, o_custkey AS project_id, CASE WHEN o_orderkey % 4 = 0 THEN 'Failed' ELSE 'Completed' END AS status, o_orderdate AS created_at, CAST(o_orderkey * 37 % 101 AS DOUBLE) AS overall"
_FOUND = "SELECT o_custkey AS project_id, l_orderkey AS crawl_id, CASE WHEN l_linenumber % 4 = 3 THEN 'Fixed' ELSE 'Open' END AS status, CASE l_suppkey % 9 WHEN 0 THEN 'Critical' ELSE 'Low' END AS severity, CASE l_partkey % 6 WHEN 0 THEN 'DUPLICATE_TITLE_TAG' WHEN 1 THEN 'THIN_CONTENT' WHEN 2 THEN 'LOW_WORD_COUNT' WHEN 3 THEN 'ORPHAN_PAGE' WHEN 4 THEN 'CANNIBALIZATION_DETECTED' ELSE 'NOINDEX' END AS code"


def _alerts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rules = spark.sql(f"{_RULE} FROM {{customer}} CROSS JOIN {_TYPES}", customer=read_table(spark, sf_dir, "customer"))
    crawls = _rows(spark, sf_dir, _STATE, "orders")
    found = spark.sql(f"{_FOUND} FROM {{lineitem}} JOIN {{orders}} ON o_orderkey = l_orderkey", lineitem=read_table(spark, sf_dir, "lineitem"), orders=read_table(spark, sf_dir, "orders"))
    return rules, accounts.alert_check(rules, crawls, crawls, found)


_FIRED = f"""r AS ({_RULE} FROM customer CROSS JOIN {_TYPES}), s AS ({_STATE} FROM orders), b AS (SELECT *, lead(overall) OVER w AS previous, row_number() OVER w AS k FROM s WINDOW w AS (PARTITION BY project_id ORDER BY created_at DESC, crawl_id DESC)),
l AS (SELECT project_id, crawl_id, status AS crawl_status, overall, previous FROM b WHERE k = 1), i AS (SELECT project_id, crawl_id, count(*) FILTER (severity = 'Critical') AS critical, count(*) FILTER (code = 'DUPLICATE_TITLE_TAG') AS clashes, count(*) FILTER (code IN ('THIN_CONTENT', 'LOW_WORD_COUNT')) AS thin, count(*) FILTER (code = 'ORPHAN_PAGE') AS orphans
  FROM ({_FOUND} FROM lineitem JOIN orders ON o_orderkey = l_orderkey) WHERE status = 'Open' GROUP BY ALL), fired AS (
SELECT r.*, overall, previous, l.crawl_id FROM r JOIN l USING (project_id) LEFT JOIN i ON i.project_id = l.project_id AND i.crawl_id = l.crawl_id WHERE is_enabled AND coalesce(CASE type WHEN 'SCORE_DROP' THEN overall < previous - threshold WHEN 'CRITICAL_ISSUE' THEN critical > 0 WHEN 'CRAWL_FAILURE' THEN crawl_status = 'Failed'
  WHEN 'CANNIBALIZATION_DETECTED' THEN clashes > 0 WHEN 'THIN_CONTENT_SPIKE' THEN thin >= threshold ELSE orphans >= threshold END, false))"""


@query("account_alerts", f"WITH {_FIRED} SELECT rule_id, project_id, type, format('{{{{\"rule\":\"{{}}\",\"score\":{{:.1f}},\"previousScore\":{{}},\"crawlId\":{{}}}}}}', type, overall, CASE WHEN previous IS NULL THEN 'null' ELSE format('{{:.1f}}', previous) END, crawl_id) AS payload FROM fired")
def account_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alerts(spark, sf_dir)[1]


@query("account_deliveries", f"WITH {_FIRED} SELECT rule_id AS event_id, project_id, channel, destination, 'Pending' AS status FROM fired WHERE channel <> 'dashboard'")
def account_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules, fired = _alerts(spark, sf_dir)
    events = fired.withColumns({"event_id": F.col("rule_id"), "detected_at": F.lit("2024-01-01").cast("timestamp")})
    return accounts.alert_events(events, rules)[1].drop("payload")


@query("account_alert_events", "SELECT user_id AS project_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events QUALIFY rank <= 100")
def account_alert_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("project_id"), F.col("event_id").alias("rule_id"), F.col("ts").alias("detected_at"), F.lit("{}").alias("payload"))
    rules = events.limit(0).select("rule_id", F.lit("email").alias("channel"), F.lit("x").alias("destination"))
    return plain(accounts.alert_events(events, rules)[0].select("project_id", "event_id", "rank"))


# Streams

_CHAIN = """f AS ({free}), ch AS (
  SELECT rule_id, min(ts) AS ts FROM f GROUP BY rule_id UNION ALL SELECT ch.rule_id, (SELECT min(ts) FROM f WHERE f.rule_id = ch.rule_id AND f.ts > ch.ts + INTERVAL 24 HOUR) FROM ch WHERE EXISTS (SELECT 1 FROM f WHERE f.rule_id = ch.rule_id AND f.ts > ch.ts + INTERVAL 24 HOUR)
) SELECT (SELECT min(event_id) FROM f WHERE f.rule_id = ch.rule_id AND f.ts = ch.ts) AS event_id, rule_id FROM ch"""
ORACLES["account_alert_cooldown"] = """WITH RECURSIVE c AS (SELECT event_id, user_id AS rule_id, ts FROM events WHERE event_type = 'error' AND event_id % 2 = 0), e AS (SELECT user_id AS rule_id, ts FROM events WHERE event_type = 'error' AND event_id % 2 = 1 AND ts < '2024-01-10'),
""" + _CHAIN.format(free="SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.rule_id = c.rule_id AND e.ts >= c.ts - INTERVAL 24 HOUR AND e.ts <= c.ts)")


def _drained(spark: SparkSession, rows: DataFrame, label: str) -> DataFrame:
    out = fresh_path(spark, label)
    streams._append(rows, out, fresh_path(spark, f"{label}-state")).awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{out}/epoch=*")


@query("stream_alerts", "WITH RECURSIVE " + _CHAIN.format(free="SELECT event_id, user_id AS rule_id, ts FROM events WHERE event_type = 'error'"))
def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = catalog._stream(spark, sf_dir, "events").filter("event_type = 'error'").select("event_id", F.col("user_id").alias("rule_id"), F.col("ts").cast("timestamp").alias("detected_at"))
    with streams.rocksdb(spark):
        return _drained(spark, streams.stream_alerts(events, expires=False), "stream-alerts").select("event_id", "rule_id")


@query("stream_discovered", "SELECT DISTINCT o_custkey % 4 AS crawl_id, concat('https://x.example/', o_custkey) AS normalized_url FROM orders WHERE o_orderkey % 3 <> 0 AND o_custkey % 10 <> 0")
def stream_discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = catalog._stream(spark, sf_dir, "orders")
    host = F.when(F.col("o_orderkey") % 3 == 0, "y.example").otherwise("x.example")
    links = orders.select((F.col("o_custkey") % 4).alias("crawl_id"), F.concat(F.lit("HTTPS://"), host, F.lit("/"), F.col("o_custkey").cast("string"), F.lit("/#top")).alias("target_url"), F.lit(0).alias("depth"), F.lit("x.example").alias("project_host"))
    known = read_table(spark, sf_dir, "customer").filter("c_custkey % 10 = 0").select((F.col("c_custkey") % 4).alias("crawl_id"), F.concat(F.lit("https://x.example/"), F.col("c_custkey").cast("string")).alias("normalized_url"))
    out = fresh_path(spark, "stream-discovered")
    streams.stream_discover(links, known, out, fresh_path(spark, "stream-discovered-state")).awaitTermination()
    return spark.read.schema("crawl_id bigint, normalized_url string, depth int").parquet(f"{out}/epoch=*").select("crawl_id", "normalized_url")


@query("stream_audited", "SELECT page_id % 4 AS crawl_id, page_id, 'HTTPS_ISSUE' AS code, 'High' AS severity FROM pages WHERE url LIKE 'http://%'")
def stream_audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = catalog._stream(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 4).alias("crawl_id"), "url", F.lit(False).alias("has_snapshot"))
    rules = [r for r in page_rules() if r.code == "HTTPS_ISSUE"]
    out = fresh_path(spark, "stream-audit")
    streams.stream_audit(pages, rules, out, fresh_path(spark, "stream-audit-state")).awaitTermination()
    return spark.read.schema("crawl_id bigint, page_id bigint, code string, severity string").parquet(f"{out}/epoch=*")
