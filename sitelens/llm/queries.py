"""Queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .conversations import damaged, digests, repair
from .embeddings import near_duplicate_vectors
from .exact import exact_dedup
from .filters import filter_masks, interactions
from .language import language_id
from .lines import dedup_lines
from .minhash import near_duplicates
from .mixing import mix
from .pieces import decode, encode
from .substring import remove_repeats
from .tokencount import count_tokens
from .toxicity import toxicity
from .urls import Rule, url_filter

URL_RULES = [
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(_table(spark, sf_dir, "pages"), URL_RULES)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    model = vocabulary("piece_bpe_32k.model")
    found = encode(docs, model, n=4, keep=("text_sha256",), merged=True).select(
        "doc_id",
        "text_sha256",
        "ids",
        F.size("ids").cast("bigint").alias("n_pieces"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.size("merged_ids").cast("bigint").alias("n_merged"),
        F.sha2(F.array_join("merged_ids", " "), 256).alias("merged_sha256"),
        F.transform("n_best", lambda p: p["score"]).alias("scores"),
        F.to_json(F.transform("n_best", lambda p: p["edits"])).alias("changes"),
    )
    kept = ("text_sha256", "n_pieces", "ids_sha256", "n_merged", "merged_sha256", "scores", "changes")
    back = decode(found, model, keep=kept)
    return back.select("doc_id", *kept[1:], (F.sha2("decoded", 256) == F.col("text_sha256")).alias("round_trip"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


MIX_WEIGHTS = {("family0",): 3, ("family1",): 2, ("*", "en"): 4, ("*", "de"): 2, ("*", "fr"): 2}


def mix_levels() -> dict[str, Column]:
    """Domains are four families of sources, by the number in the source's name; each holds several sources, none where there is no number."""
    number = F.regexp_extract("source", r"(\d+)", 1).try_cast("int")
    return {"domain": F.concat(F.lit("family"), (number % 4).cast("string")), "lang": F.col("lang"), "source": F.col("source")}


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"), mix_levels(), MIX_WEIGHTS, F.floor(F.col("total") * 3 / 4), epochs=2, seed=17)


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _table(spark, sf_dir, "conversations")
    found = repair(damaged(given))
    key = lambda df: df.select(F.struct("conv_id").alias("conv"), *[c for c in df.columns if c != "conv_id"])
    every = key(given.select("conv_id").distinct()).join(key(found.conversations), "conv", "left").join(key(digests(found.rows)), "conv", "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv.conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = filter_masks(_table(spark, sf_dir, "documents"), F.col("source"))
    return interactions(masks, _table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_minhash": op2_minhash,
    "op3_url_filter": op3_url_filter,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_language_id": op7_language_id,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_source_mixing": op9_source_mixing,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_toxicity": op11_toxicity,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_filter_audit": op13_filter_audit,
}

ORACLES = {
    "op3_url_filter": r"""
WITH r(rule, host, path, verdict) AS (
  VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
         ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')
), p AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN url[instr(url, '://') + 3:] END AS rest FROM pages
), q AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM p
), m AS (
  SELECT q.*, r.rule, r.verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(r.rule) DESC NULLS LAST, length(r.host) DESC) AS k
  FROM q LEFT JOIN r ON (q.host = r.host OR ends_with(q.host, '.' || r.host)) AND starts_with(q.path, r.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
""",
    "op4_substring_dedup": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), x AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p, len(w) AS n FROM d
), y AS (
  SELECT doc_id, p, n, md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) AS s FROM x
), z AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY s) AS k FROM y WHERE p + 34 <= n) WHERE k > 1
), c AS (
  SELECT DISTINCT doc_id, p + k AS p FROM z, range(0, 35) t(k)
), kept AS (
  SELECT x.doc_id, count(*) AS n_kept, string_agg(x.word, ' ' ORDER BY x.p) AS body
  FROM x ANTI JOIN c ON x.doc_id = c.doc_id AND x.p = c.p GROUP BY x.doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, len(d.w) - coalesce(kept.n_kept, 0) AS n_removed, sha256(coalesce(kept.body, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""",
    "op8_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
)
SELECT doc_id,
       min(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept,
       sha256(body) AS text_sha256
FROM d WINDOW w AS (PARTITION BY body)
""",
    "op9_source_mixing": r"""
WITH d AS (
  SELECT doc_id AS id, doc_id, coalesce('family' || CAST(try_cast(regexp_extract(source, '(\d+)', 1) AS INTEGER) % 4 AS VARCHAR), '') AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens
  FROM documents
), leaf AS (
  SELECT domain, lang, source, CAST(sum(n_tokens) AS HUGEINT) AS tokens, 2 * CAST(sum(n_tokens) AS HUGEINT) AS holds FROM d GROUP BY ALL
), a0 AS (
  SELECT domain, domain AS name, sum(holds) AS holds, CASE domain WHEN 'family0' THEN 3 WHEN 'family1' THEN 2 ELSE 1 END AS weight,
         (SELECT least(CAST(floor(sum(tokens) * 3 / 4) AS HUGEINT), sum(holds)) FROM leaf) AS budget
  FROM leaf GROUP BY domain
), a1 AS (
  SELECT *, holds * sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
            <= (budget - coalesce(sum(holds) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight AS is_full
  FROM a0 WINDOW o AS (ORDER BY CAST(holds AS DOUBLE) / weight, name)
), a AS (
  SELECT domain, CASE WHEN is_full THEN holds ELSE
    ((budget - coalesce(sum(holds) FILTER (is_full) OVER (), 0)) * weight) // sum(weight) FILTER (NOT is_full) OVER () END AS share
  FROM a1
), b0 AS (
  SELECT domain, lang, lang AS name, sum(holds) AS holds, CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS weight, min(share) AS budget
  FROM leaf JOIN a USING (domain) GROUP BY domain, lang
), b1 AS (
  SELECT *, holds * sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
            <= (budget - coalesce(sum(holds) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight AS is_full
  FROM b0 WINDOW o AS (PARTITION BY domain ORDER BY CAST(holds AS DOUBLE) / weight, name)
), b AS (
  SELECT domain, lang, CASE WHEN is_full THEN holds ELSE
    ((budget - coalesce(sum(holds) FILTER (is_full) OVER p, 0)) * weight) // sum(weight) FILTER (NOT is_full) OVER p END AS share
  FROM b1 WINDOW p AS (PARTITION BY domain)
), c0 AS (
  SELECT domain, lang, source, source AS name, tokens, holds, 1 AS weight, share AS budget FROM leaf JOIN b USING (domain, lang)
), c1 AS (
  SELECT *, holds * sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
            <= (budget - coalesce(sum(holds) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight AS is_full
  FROM c0 WINDOW o AS (PARTITION BY domain, lang ORDER BY CAST(holds AS DOUBLE) / weight, name)
), c2 AS (
  SELECT domain, lang, source, tokens, CASE WHEN is_full THEN holds ELSE
    ((budget - coalesce(sum(holds) FILTER (is_full) OVER p, 0)) * weight) // sum(weight) FILTER (NOT is_full) OVER p END AS leaf_budget
  FROM c1 WINDOW p AS (PARTITION BY domain, lang)
), c AS (
  SELECT domain, lang, source, leaf_budget, tokens, CASE WHEN tokens > 0 THEN leaf_budget // tokens ELSE 2 END AS whole FROM c2
), e AS (
  SELECT d.*, leaf_budget, whole, leaf_budget - whole * tokens AS rest,
         sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('17:' || CAST(whole AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)), doc_id) AS seen
  FROM d JOIN c USING (domain, lang, source)
)
SELECT doc_id, domain, lang, source, n_tokens, CAST(leaf_budget AS BIGINT) AS leaf_budget,
       CAST(least(whole + CASE WHEN seen <= rest THEN 1 ELSE 0 END, 2) AS BIGINT) AS copies
FROM e
""",
    "op12_conversation_repair": r"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations
), summed AS (
  SELECT *, xor(list_reduce(
           list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(k[i]) AS BIGINT)),
           lambda c, b: list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)),
           4294967295), 4294967295) % 20 AS h
  FROM named
), dmg AS (
  SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role,
         CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM summed, range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)
), num AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM dmg
), flt AS (
  SELECT *, role[1] AS r,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
         lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS r0
  FROM num
), tot AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (i > 1 AND r0 || r NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM flt GROUP BY conv_id
), steps AS (
  SELECT conv_id, i, r, fault IN ('blank', 'duplicate') AS must, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS t FROM flt
), dp(conv_id, i, v0, v1, v2, v3) AS (
  SELECT conv_id, CAST(0 AS BIGINT), {'c': 0, 'a': ''}, {'c': 99999999, 'a': ''}, {'c': 99999999, 'a': ''}, {'c': 99999999, 'a': ''} FROM tot
  UNION ALL
  SELECT conv_id, i, {'c': w0.c + 4, 'a': w0.a || 'D'},
         least({'c': w1.c + 4, 'a': w1.a || 'D'}, {'c': w0.c + t + ks, 'a': w0.a || 'K'}),
         least({'c': w2.c + 4, 'a': w2.a || 'D'},
               least({'c': w0.c + t + k, 'a': w0.a || e}, {'c': w1.c + t + k, 'a': w1.a || e}, {'c': w3.c + t + k, 'a': w3.a || e})),
         least({'c': w3.c + 4, 'a': w3.a || 'D'}, {'c': w2.c + t + k3, 'a': w2.a || e3})
  FROM (
    SELECT conv_id, i, t, r, w0, w1, w2, least(w3, {'c': w2.c + 3, 'a': w2.a || 'I'}) AS w3,
           CASE WHEN r = 's' AND NOT must THEN 0 ELSE 99999999 END AS ks,
           CASE WHEN must THEN 99999999 WHEN r = 'u' THEN 0 ELSE 3 END AS k, CASE WHEN must THEN 99999999 WHEN r = 'a' THEN 0 ELSE 3 END AS k3,
           CASE r WHEN 'u' THEN 'K' ELSE 'R' END AS e, CASE r WHEN 'a' THEN 'K' ELSE 'R' END AS e3
    FROM (
      SELECT dp.conv_id, s.i, s.t, s.r, s.must, v0 AS w0, v1 AS w1, v3 AS w3,
             least(v2, {'c': v0.c + 3, 'a': v0.a || 'I'}, {'c': v1.c + 3, 'a': v1.a || 'I'}, {'c': v3.c + 3, 'a': v3.a || 'I'}) AS w2
      FROM dp JOIN steps s ON s.conv_id IS NOT DISTINCT FROM dp.conv_id AND s.i = dp.i + 1
    )
  )
), best AS (
  SELECT tot.*, least(v0, v3, {'c': v2.c + 3, 'a': v2.a || 'I'}, {'c': v1.c + 6, 'a': v1.a || 'II'}) AS b
  FROM tot JOIN dp ON tot.conv_id IS NOT DISTINCT FROM dp.conv_id AND tot.n = dp.i
), chars AS (
  SELECT conv_id, b.a AS audit, p, b.a[p] AS ch, length(replace(b.a[1:p], 'I', '')) AS i,
         length(replace(b.a[1:p], 'D', '')) AS at, length(replace(b.a, 'D', '')) AS m
  FROM best, range(1, length(b.a) + 1) t(p)
), lines AS (
  SELECT c.conv_id, string_agg(
           CASE c.ch WHEN 'K' THEN f.role ELSE CASE (c.at + c.m) % 2 WHEN 0 THEN 'assistant' ELSE 'user' END END || ':' || CASE c.ch WHEN 'I' THEN '' ELSE f.text END,
           chr(10) ORDER BY p) AS body
  FROM chars c LEFT JOIN flt f ON f.conv_id IS NOT DISTINCT FROM c.conv_id AND f.i = c.i WHERE c.ch <> 'D' GROUP BY c.conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(CAST(b.b.c AS BIGINT), 0) AS cost, coalesce(b.b.a, '') AS audit, sha256(coalesce(l.body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM o.conv_id
""",
    "op13_filter_audit": r"""
WITH RECURSIVE orders(filter_order, rest) AS (
  SELECT '', 'ABCDE'
  UNION ALL
  SELECT filter_order || f, replace(rest, f, '') FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(f) WHERE contains(rest, f)
), steps AS (
  SELECT filter_order, step, filter_order[step] AS f, filter_order[1:step - 1] AS before
  FROM orders, range(1, 6) t(step) WHERE length(filter_order) = 5
), d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body FROM documents
), w AS (
  SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY body) AS first_id FROM d
), m AS (
  SELECT part, doc_id,
         CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 2 * length(body) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > first_id THEN 'E' ELSE '' END AS fails
  FROM w
), c AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS bad
  FROM m LEFT JOIN labels USING (doc_id) GROUP BY part, fails
), r AS (
  SELECT part, filter_order, step, n, good, bad, fails, f, contains(fails, f) AS failing,
         length(translate(fails, before, '')) < length(fails) AS gone
  FROM c, steps
), s AS (
  SELECT part, filter_order, step, any_value(f) AS f,
         coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0) AS kept,
         coalesce(sum(n) FILTER (failing AND NOT gone), 0) AS removed,
         coalesce(sum(n) FILTER (failing AND gone), 0) AS redundant,
         coalesce(sum(n) FILTER (fails = f), 0) AS unique_fails,
         coalesce(sum(good) FILTER (failing AND NOT gone), 0) AS good_lost,
         coalesce(sum(bad) FILTER (failing AND NOT gone), 0) AS toxic_lost
  FROM r GROUP BY part, filter_order, step
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM s
""",
}
