"""Read views over audits: issues, scores, dashboards, pages, content, overviews, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import readability, stuffed
from ..operators.ranks import ranked
from .accounts import worst_first


def issue_list(issues: DataFrame, pages: DataFrame) -> DataFrame:
    """Issues with their page's url, ranked by severity and code."""
    rows = issues.join(pages.select("page_id", "url"), "page_id", "left")
    return ranked(rows, "crawl_id", [*worst_first(rows), "page_id"])


def latest_per(rows: DataFrame, by: str, at: str, tie: str, top: int = 1) -> DataFrame:
    """The newest ``top`` rows of each ``by``, numbered."""
    order = W.partitionBy(by).orderBy(F.desc(at), F.desc(tie))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def latest_score(scores: DataFrame) -> DataFrame:
    return latest_per(scores, "project_id", "created_at", "crawl_id")


def score_history(scores: DataFrame, top: int = 100) -> DataFrame:
    return latest_per(scores, "project_id", "created_at", "crawl_id", top)


def dashboard(crawls: DataFrame, issues: DataFrame, scores: DataFrame, top: int = 8) -> DataFrame:
    """Each project's latest crawl: open issues, urgent ones, its own score, and the first issues."""
    last = latest_per(crawls, "project_id", "created_at", "crawl_id").select("project_id", "crawl_id", "status")
    open_ = issues.filter(F.col("status") == "Open")
    counts = open_.groupBy("crawl_id").agg(F.count(F.lit(1)).alias("open_issues"), F.count_if(F.col("severity").isin("High", "Critical")).alias("urgent"))
    order = W.partitionBy("crawl_id").orderBy(*worst_first(open_), "page_id")
    first = open_.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= top).groupBy("crawl_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "code"))), lambda x: x["code"]).alias("top_codes"))
    own = scores.select("crawl_id", "overall")
    return last.join(counts, "crawl_id", "left").join(own, "crawl_id", "left").join(first, "crawl_id", "left").fillna(0, ["open_issues", "urgent"])


def recommendation_list(recommendations: DataFrame, issues: DataFrame | None = None, status: str | None = None) -> DataFrame:
    """Recommendations by priority, newest first; of one set of issues, of one status."""
    rows = recommendations
    if issues is not None:
        rows = rows.join(issues.select("issue_id"), "issue_id", "left_semi")
    if status is not None:
        rows = rows.filter(F.col("status") == status)
    return ranked(rows, "project_id", [F.desc("priority"), F.desc("created_at"), "issue_id"])


def crawl_list(crawls: DataFrame, analyses: DataFrame) -> DataFrame:
    """Crawls, newest first, with the state of their analysis."""
    rows = crawls.join(analyses.select("crawl_id", F.col("status").alias("analysis_status")), "crawl_id", "left")
    return ranked(rows, "project_id", [F.desc("created_at"), F.desc("crawl_id")])


def analysis_status(crawls: DataFrame, analyses: DataFrame, jobs: DataFrame, scores: DataFrame, issues: DataFrame) -> DataFrame:
    """State of each crawl's analysis: latest job by its key, whether a score exists, issue counts, whether to retry."""
    keyed = jobs.withColumn("crawl_id", F.regexp_extract("idempotency_key", r"^analyze:([^:]+)", 1)).filter("crawl_id <> ''")
    job = keyed.groupBy("crawl_id").agg(F.max_by("status", "created_at").alias("job_status"))
    counts = issues.groupBy("crawl_id").agg(F.count(F.lit(1)).alias("issues"), F.count_if(F.col("severity") == "Critical").alias("critical"))
    rows = crawls.select(F.col("crawl_id").cast("string").alias("crawl_id"), F.col("status").alias("crawl_status"))
    rows = rows.join(analyses.select(F.col("crawl_id").cast("string").alias("crawl_id"), F.col("status").alias("analysis_status")), "crawl_id", "left").join(job, "crawl_id", "left")
    rows = rows.join(scores.select(F.col("crawl_id").cast("string").alias("crawl_id"), F.lit(True).alias("has_score")), "crawl_id", "left").join(counts.withColumn("crawl_id", F.col("crawl_id").cast("string")), "crawl_id", "left")
    retry = (F.col("crawl_status") == "Completed") & (F.coalesce("analysis_status", F.lit("")) == "Failed") & ~F.coalesce("job_status", F.lit("")).isin("Pending", "Running")
    return rows.withColumn("has_score", F.coalesce("has_score", F.lit(False))).fillna(0, ["issues", "critical"]).withColumn("retryable", retry)


def page_browser(pages: DataFrame, page: int, size: int = 50) -> DataFrame:
    """Page number ``page`` of a crawl's pages by url, with the total; at most 200 to a page."""
    size = max(1, min(200, size))
    shown = ranked(pages, "crawl_id", ["url", "page_id"], "n", ((page - 1) * size + 1, page * size))
    totals = pages.groupBy("crawl_id").agg(F.count(F.lit(1)).alias("total"))
    return shown.join(totals, "crawl_id")


def pages_after(pages: DataFrame, crawl_id: object, url: str | None = None, page_id: object = None, size: int = 50) -> DataFrame:
    """The pages of a crawl that follow a given one in order of url and id, at most 200: paging by the last key seen.

    The filter reaches the scan, and of each task no more rows than a page go on.
    """
    rows = pages.filter(F.col("crawl_id") == F.lit(crawl_id))
    if url is not None:
        rows = rows.filter((F.col("url") > url) | ((F.col("url") == url) & (F.col("page_id") > F.lit(page_id))))
    return rows.orderBy("url", "page_id").limit(max(1, min(200, size)))


def redirects(pages: DataFrame) -> DataFrame:
    return pages.filter(F.size("redirects") > 0).withColumn("hops", F.size("redirects"))


def assets(pages: DataFrame, kind: str | None = None, mixed_only: bool = False) -> DataFrame:
    """Asset inventory, of one type, of mixed content only."""
    rows = pages.select("crawl_id", "page_id", F.explode("assets").alias("a")).select("crawl_id", "page_id", "a.*")
    if kind is not None:
        rows = rows.filter(F.col("type") == kind)
    return rows.filter("mixed") if mixed_only else rows


def content_analysis(pages: DataFrame) -> DataFrame:
    """Readability and stuffing of each page."""
    rows = pages.select("crawl_id", "page_id", readability(F.col("text")).alias("r"), stuffed(F.col("text")).alias("stuffing"))
    return rows.select("crawl_id", "page_id", "r.*", "stuffing", (F.col("r.words") < 150).alias("thin"))


def content_summary(analysis: DataFrame) -> DataFrame:
    return analysis.groupBy("crawl_id").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("words").alias("words"), F.bround(F.avg(F.col("score").cast("decimal(18,6)")), 1).cast("decimal(5,1)").alias("mean_score"),
        F.count_if("thin").alias("thin_pages"), F.count_if("stuffing").alias("stuffing_pages"),
    )


def audit_log_list(log: DataFrame, top: int = 200) -> DataFrame:
    return latest_per(log, "project_id", "created_at", "id", top)


# Roles that may do a thing.
RIGHTS = {"view": ["Owner", "Admin", "Editor", "Viewer"], "edit": ["Owner", "Admin", "Editor"], "manage": ["Owner", "Admin"]}


def visible_projects(projects: DataFrame, members: DataFrame, right: str = "view") -> DataFrame:
    """(user_id, project_id) pairs: owned projects, and those a role lets the user into."""
    own = projects.select(F.col("owner_id").alias("user_id"), "project_id")
    return own.union(members.filter(F.col("role").isin(RIGHTS[right])).select("user_id", "project_id")).distinct()


def member_list(members: DataFrame, users: DataFrame) -> DataFrame:
    return members.join(users.select("user_id", "email", "name"), "user_id")


def evidence_overview(pages: DataFrame, graph: DataFrame, content: DataFrame, titles: DataFrame, issues: DataFrame, keywords: DataFrame, competitors: DataFrame, top: int = 50) -> DataFrame:
    """One row per crawl with the figures a summary is written from, and a hash of them."""
    site = pages.groupBy("crawl_id", "project_id").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if("is_indexable").alias("indexable"), F.count_if(F.col("status") >= 400).alias("errors"),
        F.bround(F.avg("response_ms"), 1).alias("mean_ms"), F.min_by("url", F.struct(-F.col("status"), -F.col("response_ms"), "url")).alias("worst_page"),
    )
    links = graph.join(pages.select("page_id", "crawl_id"), "page_id").groupBy("crawl_id").agg(F.count_if("is_orphan").alias("orphans"), F.count_if("is_dead_end").alias("dead_ends"), F.sum("out_degree").alias("internal_links"))
    text = content_summary(content).select("crawl_id", "thin_pages", "stuffing_pages", "mean_score")
    double = titles.join(pages.select("page_id", "crawl_id"), "page_id").groupBy("crawl_id").agg(F.count(F.lit(1)).alias("duplicate_titles"))
    tracked = keywords.groupBy("project_id").agg(F.count_if("is_tracked").alias("tracked_keywords"))
    rivals = competitors.groupBy("project_id").agg(F.count_if("is_active").alias("active_competitors"))
    order = W.partitionBy("crawl_id").orderBy(*worst_first(issues), "page_id")
    first = issues.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= top).groupBy("crawl_id").agg(F.array_sort(F.collect_list(F.struct("k", "code", "severity"))).alias("top_issues"))
    urgent = issues.groupBy("crawl_id").agg(F.count_if(F.col("severity") == "Critical").alias("critical"), F.count_if(F.col("severity") == "High").alias("high"))
    rows = site.join(links, "crawl_id", "left").join(text, "crawl_id", "left").join(double, "crawl_id", "left").join(urgent, "crawl_id", "left").join(first, "crawl_id", "left")
    rows = rows.join(tracked, "project_id", "left").join(rivals, "project_id", "left")
    rows = rows.fillna(0, ["orphans", "dead_ends", "internal_links", "duplicate_titles", "critical", "high", "tracked_keywords", "active_competitors"])
    return rows.withColumn("packet_hash", F.sha2(F.to_json(F.struct(*rows.columns)), 256))


# What a figure above zero means, in the order in which it is told: observation, cause, recommendation, action.
FINDINGS = [
    ("errors", "pages answer with an error", "Broken or moved addresses", "Repair the errors and the links to them", "Go through the failing addresses and redirect them"),
    ("orphans", "pages have no internal link to them", "New pages missing in navigation", "Link them from pages of high authority", "Add them to navigation and to related pages"),
    ("dead_ends", "pages link nowhere", None, "Add related content at their end", "Put related links and breadcrumbs on them"),
    ("thin_pages", "pages hold little text", "Pages published unfinished", "Extend them or keep them out of the index", "Complete the most visited ones first"),
    ("stuffing_pages", "pages repeat a term too often", "Over-optimised text", "Vary the wording", "Rewrite the repeated passages"),
    ("duplicate_titles", "pages share a title", "Several pages aim at one phrase", "Merge them or name a canonical page", "Choose the main page and retitle the others"),
]
# Texts that stand where nothing else was found.
STEADY = ("The crawl shows no change to report", "Gradual changes without a regular audit", "Keep watching and write about new keywords", "Check once a month and compare with competitors")
# What is missing if a figure is zero.
MISSING = [("tracked_keywords", "No keyword is tracked"), ("active_competitors", "No competitor is active")]


def evidence_summary(overview: DataFrame) -> DataFrame:
    """The texts of each crawl's summary: observations, causes, recommendations, actions, missing evidence, and the findings behind them.

    A crawl with pages always states their number, the share that can be indexed
    and the mean time; steady texts stand in where nothing was found; a figure
    of zero for keywords or competitors is told as missing, an unknown one isn't.
    """
    fields = ("metric", "observation", "cause", "recommendation", "action")
    table = F.array(*[F.struct(F.col(f[0]).cast("bigint").alias("value"), *[F.lit(v).cast("string").alias(n) for n, v in zip(fields, f, strict=True)]) for f in FINDINGS])
    rows = overview.withColumn("findings", F.filter(table, lambda x: x["value"] > 0))
    share = F.bround(F.col("indexable").cast("decimal(18,0)") * 100 / F.col("pages"), 1).cast("decimal(4,1)").cast("string")
    stated = F.concat_ws(" ", F.col("pages").cast("string"), F.lit("pages,"), F.col("indexable").cast("string"), F.lit("of them indexable ("), share, F.lit("%), mean time"), F.floor("mean_ms").cast("string"), F.lit("ms"))
    told = F.when(F.col("pages") > 0, F.array(stated)).otherwise(F.array().cast("array<string>"))
    observations = F.concat(told, F.transform("findings", lambda x: F.concat_ws(" ", x["value"].cast("string"), x["observation"])))
    listed = lambda name: F.array_compact(F.array_distinct(F.transform("findings", lambda x: x[name])))
    nothing = F.size(observations) == 0
    otherwise = lambda found, empty, text: F.when(empty, F.concat(found, F.array(F.lit(text)))).otherwise(found)
    missing = F.array_compact(F.array(*[F.when(F.col(c) == 0, text) for c, text in MISSING]))
    return rows.select(
        "crawl_id", "critical", "high",
        otherwise(observations, nothing, STEADY[0]).alias("observations"), otherwise(listed("cause"), F.size(listed("cause")) == 0, STEADY[1]).alias("causes"),
        otherwise(listed("recommendation"), nothing, STEADY[2]).alias("recommendations"), otherwise(listed("action"), nothing, STEADY[3]).alias("actions"),
        missing.alias("missing"), F.transform("findings", lambda x: F.struct(x["metric"].alias("metric"), x["value"].alias("value"))).alias("findings"),
    )


def stalled_crawls(crawls: DataFrame, jobs: DataFrame) -> DataFrame:
    """Queued or running crawls that no active crawl job names in its key."""
    active = jobs.filter(F.col("status").isin("Pending", "Running")).select(F.regexp_extract("idempotency_key", r"^crawl:([^:]+)", 1).alias("crawl_id")).filter("crawl_id <> ''").distinct()
    waiting = crawls.filter(F.col("status").isin("Queued", "Running")).withColumn("crawl_id", F.col("crawl_id").cast("string"))
    return waiting.join(active, "crawl_id", "left_anti")


def kept_rows(rows: DataFrame, at: str, days: dict[str, int], now: Column, status: str | None = "status") -> tuple[DataFrame, DataFrame]:
    """Rows that stay and rows that expire: each status has its days (at least one); other statuses stay."""
    if status is None:
        gone = F.col(at) < now - F.make_dt_interval(F.lit(max(1, days["*"])))
    else:
        gone = F.lit(False)
        for name, n in days.items():
            gone = gone | ((F.col(status) == name) & (F.col(at) < now - F.make_dt_interval(F.lit(max(1, n)))))
    gone = F.coalesce(gone, F.lit(False))
    return rows.filter(~gone), rows.filter(gone)


def delivery_backlog(deliveries: DataFrame, now: Column) -> DataFrame:
    """Deliveries that are due, the oldest first, with the wait after their next failure."""
    due = F.col("status").isin("Pending", "Failed", "Processing") & (F.col("next_attempt_at") <= now) & (F.col("locked_until").isNull() | (F.col("locked_until") < now))
    wait = F.least(F.lit(60), F.pow(F.lit(2), F.least(F.lit(6), F.greatest(F.col("attempts"), F.lit(0))))).cast("int")
    rows = deliveries.filter(due).withColumn("backoff_minutes", wait).withColumn("dead_letter", F.col("attempts") + 1 >= 10)
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("project_id").orderBy("next_attempt_at", "id")))
