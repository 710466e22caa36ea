"""Page rules: every rule is a column, all of them are evaluated in one narrow pass.

A rule returns (triggered, severity, actual, expected).  ``RULES`` holds them in
order of registration; a user's own rule is a function of the same shape passed
to ``evaluate_rules``.  Pages are rows of page evidence (see ``page_evidence``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.evidence import is_json
from ..functions.text import blank, readability, stuffed, utrim
from ..functions.urls import host, is_http, path, port, query, scheme

SEVERITIES = ["Notice", "Low", "Medium", "High", "Critical"]
CATEGORIES = ["Technical", "Indexability", "OnPage", "Content", "InternalLinks", "StructuredData", "Performance", "International", "Security"]


@dataclass(frozen=True)
class Rule:
    """A rule: its code, category, severity (a name or a column) and condition."""

    code: str
    category: str
    severity: str | Callable[[], Column]
    fires: Callable[[], Column]
    field: str
    actual: Callable[[], Column]
    expected: str
    transport: bool = False  # evaluated on pages without a snapshot too
    reads_text: bool = False  # uses _stuffing or _read, which are computed only if a rule asks


def _c(name: str) -> Callable[[], Column]:
    return lambda: F.col(name)


def _count(items: str, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(F.coalesce(F.col(items), F.array()), test))


def _assets(test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(F.col("assets"), test))


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda a: a["type"] == kind


def _header(name: str) -> Column:
    return F.exists(F.map_keys(F.col("headers")), lambda k: F.lower(k) == name)


def _h1() -> Column:
    return F.size(F.filter("headings", lambda h: h["level"] == 1))


def _length(name: str) -> Column:
    return F.coalesce(F.length(utrim(F.col(name))), F.lit(0))


def _canonical_differs() -> Column:
    a, b = F.col("canonical"), F.col("url")
    bare = lambda u: F.regexp_replace(path(u), "/+$", "")
    default = lambda u: F.coalesce(port(u), F.when(scheme(u) == "https", "443").otherwise("80"))
    return is_http(a) & is_http(b) & ~((scheme(a) == scheme(b)) & (host(a) == host(b)) & (default(a) == default(b)) & (bare(a) == bare(b)) & (query(a) == query(b)))


def _same_page(a: Column, b: Column) -> Column:
    bare = lambda u: F.lower(F.regexp_replace(path(u), "/+$", ""))
    return F.coalesce(is_http(a) & is_http(b) & (host(a) == host(b)) & (bare(a) == bare(b)), F.lit(False))


def _json(block: Column, name: str) -> Column:
    return F.get_json_object(block, f"$['{name}']")


def _schema_broken(block: Column) -> Column:
    return ~is_json(block) | F.coalesce(F.trim(_json(block, "@type")) == "", F.lit(True))


def _schema_lacks(block: Column) -> Column:
    kind = F.coalesce(F.lower(_json(block, "@type")), F.lit(""))
    has = lambda name: _json(block, name).isNotNull()
    items = F.coalesce(F.json_array_length(_json(block, "itemListElement")), F.lit(0))
    return (
        F.when(kind.contains("article"), ~(has("headline") | has("name")) | ~has("author"))
        .when(kind == "product", ~has("name") | ~(has("offers") | has("review") | has("aggregateRating")))
        .when(kind == "breadcrumblist", items == 0)
        .otherwise(F.lit(False))
    )


def page_rules(low_words: int = 250, slow_ms: int = 1500, max_blocking: int = 3, max_scripts: int = 25, max_assets: int = 75) -> list[Rule]:
    """The 36 rules in order of registration, with their thresholds as parameters."""
    ok = lambda: F.col("status") == 200
    https = lambda: F.coalesce(scheme(F.col("url")) == "https", F.lit(False))
    mixed = lambda: F.when(https(), _assets(lambda a: a["mixed"])).otherwise(0)
    scripts = lambda: _assets(_is("Script"))
    blocking = lambda: _assets(lambda a: (a["type"] == "Script") & ~F.coalesce(a["is_async"], F.lit(False)) & ~F.coalesce(a["is_defer"], F.lit(False)))
    sizeless = lambda: _assets(lambda a: (a["type"] == "Image") & (blank(a["width"]) | blank(a["height"])))
    tag = r"^(?:[a-zA-Z]{2,3}(?:-[a-zA-Z0-9]{2,8})*|x-default)$"
    bad_tags = lambda: F.filter("hreflang", lambda h: ~F.coalesce(utrim(h["language"]).rlike(tag), F.lit(False)))
    self_link = lambda: F.exists("hreflang", lambda h: _same_page(h["target"], F.col("url")) | _same_page(h["target"], F.col("canonical")))
    enough_text = lambda: ~blank(F.col("text")) & (F.col("word_count") >= 100)
    noindex = lambda name: lambda: F.coalesce(F.lower(F.col(name)).contains("noindex"), F.lit(False))
    levels = lambda: F.col("headings.level")
    skips = lambda: F.exists(
        F.zip_with(levels(), F.slice(levels(), F.lit(2), F.greatest(F.size(levels()), F.lit(1))), lambda a, b: F.coalesce(b - a > 1, F.lit(False))), lambda x: x
    )
    return [
        Rule("TITLE_MISSING", "OnPage", "High", lambda: blank(F.col("title")), "title", _c("title"), "A title"),
        Rule("TITLE_LENGTH", "OnPage", "Medium", lambda: _length("title").between(1, 19) | (_length("title") > 65), "titleLength", lambda: _length("title"), "20 to 65 characters"),
        Rule("META_DESCRIPTION_MISSING", "OnPage", "Medium", lambda: blank(F.col("meta_description")), "metaDescription", _c("meta_description"), "A description"),
        Rule("H1_MISSING", "OnPage", "High", lambda: _h1() == 0, "h1", _h1, "One h1"),
        Rule("MULTIPLE_H1", "OnPage", "Medium", lambda: _h1() > 1, "h1", _h1, "One h1"),
        Rule("CANONICAL_MISSING", "Indexability", "Medium", lambda: blank(F.col("canonical")), "canonical", _c("canonical"), "A canonical URL"),
        Rule("LOW_WORD_COUNT", "Content", "Low", lambda: F.col("word_count") < low_words, "wordCount", _c("word_count"), f"{low_words} words or more"),
        Rule("ALT_MISSING", "OnPage", "Low", lambda: F.col("missing_alt") > 0, "missingAlt", _c("missing_alt"), "0"),
        Rule("SLOW_RESPONSE", "Performance", "Medium", lambda: F.col("response_ms") > slow_ms, "responseMs", _c("response_ms"), f"{slow_ms} ms or less"),
        Rule("META_DESCRIPTION_LENGTH", "OnPage", "Low", lambda: _length("meta_description").between(1, 69) | (_length("meta_description") > 170), "metaDescriptionLength", lambda: _length("meta_description"), "70 to 170 characters"),
        Rule("CANONICAL_INVALID", "Indexability", "High", lambda: ~blank(F.col("canonical")) & ~is_http(F.col("canonical")), "canonical", _c("canonical"), "An absolute http(s) URL"),
        Rule("CANONICAL_MISMATCH", "Indexability", "Medium", _canonical_differs, "canonical", _c("canonical"), "The page's own URL"),
        Rule("NOINDEX", "Indexability", "High", noindex("robots_meta"), "robotsMeta", _c("robots_meta"), "No noindex"),
        Rule("HTTPS_ISSUE", "Security", "High", lambda: scheme(F.col("url")).isNotNull() & ~https(), "url", _c("url"), "https", True),
        Rule("HEADING_STRUCTURE", "OnPage", "Low", skips, "headings", lambda: levels().cast("string"), "Levels without gaps"),
        Rule("BROKEN_STATUS", "Technical", lambda: F.when(F.col("status") >= 500, "High").otherwise("Medium"), lambda: F.col("status") >= 400, "statusCode", _c("status"), "Below 400", True),
        Rule("REDIRECTED_PAGE", "Technical", "Notice", lambda: F.col("status").between(300, 399), "statusCode", _c("status"), "200", True),
        Rule("X_ROBOTS_NOINDEX", "Indexability", "High", noindex("x_robots"), "xRobotsTag", _c("x_robots"), "No noindex"),
        Rule("CONTENT_TYPE_MISSING", "Technical", "Low", lambda: blank(F.col("content_type")), "contentType", _c("content_type"), "A content type", True),
        Rule("REDIRECT_CHAIN_LONG", "Technical", "Medium", lambda: F.size("redirects") > 2, "redirectHops", lambda: F.size("redirects"), "2 hops or fewer", True),
        Rule("MIXED_CONTENT_ASSETS", "Security", "High", lambda: mixed() > 0, "mixedAssets", mixed, "0"),
        Rule("EXCESSIVE_RESOURCES", "Performance", "Low", lambda: (scripts() > max_scripts) | (F.size("assets") > max_assets), "resources", lambda: F.size("assets"), f"{max_scripts} scripts and {max_assets} assets or fewer"),
        Rule("SCHEMA_SYNTAX_INVALID", "StructuredData", "Medium", lambda: F.exists("json_ld", _schema_broken), "schemaSyntax", lambda: F.size(F.filter("json_ld", _schema_broken)), "Objects with a type"),
        Rule("SCHEMA_MISSING_REQUIRED", "StructuredData", "Low", lambda: F.exists("json_ld", _schema_lacks), "missingProperties", lambda: F.size(F.filter("json_ld", _schema_lacks)), "The type's required fields"),
        Rule("STRUCTURED_DATA_ABSENT", "StructuredData", "Notice", lambda: F.col("is_indexable") & ok() & (F.size("json_ld") == 0), "schema", lambda: F.size("json_ld"), "Structured data"),
        Rule("HREFLANG_NO_SELF_REFERENCE", "International", "Medium", lambda: (F.size("hreflang") > 0) & ~self_link(), "hreflangSelf", lambda: F.size("hreflang"), "An entry for the page itself"),
        Rule("HREFLANG_INVALID_CODE", "International", "Medium", lambda: F.size(bad_tags()) > 0, "invalidHreflangTags", lambda: F.array_join(F.transform(bad_tags(), lambda h: h["language"]), ", ", "null"), "Language tags or x-default"),
        Rule("HSTS_MISSING", "Security", "Medium", lambda: https() & ok() & ~_header("strict-transport-security"), "hstsHeader", lambda: F.lit("Missing"), "Strict-Transport-Security", True),
        Rule("SECURITY_HEADERS_MISSING", "Security", "Low", lambda: ok() & (F.size("headers") > 0) & ~(_header("x-content-type-options") & (_header("x-frame-options") | _header("content-security-policy"))), "securityHeaders", lambda: F.size("headers"), "nosniff and a frame policy", True),
        Rule("CACHE_CONTROL_MISSING", "Technical", "Low", lambda: ok() & ~_header("cache-control"), "cacheControl", lambda: F.lit("Missing"), "Cache-Control", True),
        Rule("RENDER_BLOCKING_RESOURCES", "Performance", "Medium", lambda: blocking() > max_blocking, "renderBlockingScripts", blocking, f"{max_blocking} or fewer"),
        Rule("IMAGE_DIMENSIONS_MISSING", "Performance", "Low", lambda: sizeless() > 0, "imagesWithoutDimensions", sizeless, "0"),
        Rule("DEEP_CLICK_DEPTH", "Technical", "Medium", lambda: F.col("depth") > 3, "depth", _c("depth"), "3 clicks or fewer", True),
        Rule("KEYWORD_STUFFING", "Content", "High", lambda: enough_text() & F.col("_stuffing"), "keywordDensity", _c("_stuffing"), "Below 3.5 %", False, True),
        Rule("CONTENT_LONG_SENTENCES", "Content", "Low", lambda: enough_text() & (F.col("_read.sentences") >= 4) & (F.col("_read.long_share") > 30), "longSentences", _c("_read.long_share"), "30 % or fewer", False, True),
        Rule("THIN_CONTENT", "Content", "Medium", lambda: F.col("is_indexable") & ok() & F.col("word_count").between(1, 149), "wordCount", _c("word_count"), "150 words or more"),
    ]


def evaluate_rules(pages: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Every rule on every page: crawl_id, page_id, code, triggered, severity, category, evidence.

    Rows that did not fire are returned too; the score needs them.  A page
    without a snapshot (``has_snapshot`` false) only gets the transport rules.
    """
    rules = page_rules() if rules is None else rules
    rows = pages
    if any(r.reads_text for r in rules):
        rows = rows.withColumns({"_stuffing": stuffed(F.col("text")), "_read": readability(F.col("text"))})
    results = [
        F.struct(
            F.lit(r.code).alias("code"),
            F.coalesce(r.fires(), F.lit(False)).alias("triggered"),
            (F.lit(r.severity) if isinstance(r.severity, str) else r.severity()).alias("severity"),
            F.lit(r.category).alias("category"),
            F.struct(F.lit(r.field).alias("field"), r.actual().cast("string").alias("actual"), F.lit(r.expected).alias("expected")).alias("evidence"),
            F.lit(r.transport).alias("transport"),
        )
        for r in rules
    ]
    exploded = rows.select("crawl_id", "page_id", "has_snapshot", F.explode(F.array(*results)).alias("r"))
    return exploded.filter("has_snapshot or r.transport").select("crawl_id", "page_id", "r.code", "r.triggered", "r.severity", "r.category", "r.evidence")


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)
