"""The internal link graph: resolution, degrees, authority, anchors, findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import blank, is_generic_anchor, utrim
from ..plans.durable import Scratch


#: Tables of a row a page are broadcast up to this many pages (a few MB), so that what the driver gets doesn't grow with the pages.
BROADCAST_PAGES = 50_000


def _by_page(rows: DataFrame, pages: int) -> DataFrame:
    """One side of a join on pages: with very many pages it is shuffled, whatever its size on disk."""
    return rows if pages <= BROADCAST_PAGES else rows.hint("shuffle_merge")


def resolve_links(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Links (source_id, target_url, anchor) with the id of the page they lead to; the lowest id wins."""
    at = pages.groupBy(F.lower("url").alias("key")).agg(F.min("page_id").alias("target_id"))
    known = links.withColumn("key", F.lower("target_url")).join(at, "key").drop("key")
    return known.join(pages.select(F.col("page_id").alias("source_id")).distinct(), "source_id", "left_semi")


def edges(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct edges (source_id, target_id) between known pages; self-links stay."""
    ids = pages.select("page_id").distinct()
    inside = links.join(ids.withColumnRenamed("page_id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("page_id", "target_id"), "target_id", "left_semi")
    return inside.select("source_id", "target_id").distinct()


def link_graph(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Degrees and flags of each page (page_id, is_root, in_seeds): orphan, weak, dead end."""
    known = edges(pages, links)
    inbound = known.groupBy(F.col("target_id").alias("page_id")).agg(F.count(F.lit(1)).alias("in_degree"))
    outbound = known.groupBy(F.col("source_id").alias("page_id")).agg(F.count(F.lit(1)).alias("out_degree"))
    rows = pages.join(inbound, "page_id", "left").join(outbound, "page_id", "left").fillna(0, ["in_degree", "out_degree"])
    return rows.select(
        "page_id", "in_degree", "out_degree",
        (~F.col("is_root") & F.col("in_seeds") & (F.col("in_degree") == 0)).alias("is_orphan"),
        (~F.col("is_root") & (F.col("in_degree") <= 1)).alias("is_weak"),
        ((F.col("out_degree") == 0) & (F.col("in_degree") > 0)).alias("is_dead_end"),
    )


def internal_authority(pages: DataFrame, links: DataFrame, iterations: int = 20, damping: float = 0.85) -> DataFrame:
    """PageRank with the mass of pages without links spread evenly, scaled to a highest value of 100.

    Each round is one join on the source and one aggregation, and is written; the
    lost mass is observed while the round before is written, so no round reads
    another twice.  Of very many pages nothing is broadcast.
    """
    scratch = Scratch(pages.sparkSession, "authority")
    nodes = scratch.save(pages.select("page_id").distinct(), "nodes")
    n = nodes.count()
    if not n:
        return nodes.withColumn("authority", F.lit(0.0))
    known = scratch.save(edges(_by_page(nodes, n), links), "known")
    out = known.groupBy("source_id").agg(F.count(F.lit(1)).alias("out"))
    weighted = scratch.save(known.join(_by_page(out, n), "source_id").select("source_id", "target_id", (1 / F.col("out")).alias("share")), "edges")
    leads = known.select(F.col("source_id").alias("page_id"), F.lit(True).alias("leads")).distinct()
    first = nodes.join(_by_page(leads, n), "page_id", "left").select("page_id", F.lit(1.0 / n).alias("rank"), F.coalesce("leads", F.lit(False)).alias("leads"))
    top = 0.0
    rank = None
    for i in range(iterations + 1):
        if rank is None:
            now = first
        else:
            passed = _by_page(rank, n).join(weighted, F.col("page_id") == F.col("source_id")).groupBy(F.col("target_id").alias("page_id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
            now = rank.join(_by_page(passed, n), "page_id", "left").select("page_id", (F.lit((1 - damping) / n + damping * lost / n) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"), "leads")
        seen = Observation()
        rank = scratch.save(now.observe(seen, F.sum(F.when(~F.col("leads"), F.col("rank"))).alias("lost"), F.max("rank").alias("top")), f"rank-{i}")
        lost, top = seen.get["lost"] or 0.0, seen.get["top"]
        scratch.drop(f"rank-{i - 1}")
    scratch.drop("nodes", "known", "edges")
    return rank.select("page_id", F.bround(F.col("rank") / F.lit(top) * 100, 2).alias("authority"))


def top_anchors(pages: DataFrame, links: DataFrame, limit: int = 50) -> DataFrame:
    """The most frequent link texts between known pages, case aside; the lowest spelling is shown."""
    ids = pages.select("page_id").distinct()
    valid = links.join(ids.withColumnRenamed("page_id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("page_id", "target_id"), "target_id", "left_semi")
    text = utrim(F.col("anchor"))
    counts = valid.filter(~blank(F.col("anchor"))).groupBy(F.lower(text).alias("key")).agg(F.min(text).alias("anchor"), F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "key").limit(limit).select("anchor", "n", is_generic_anchor(F.col("anchor")).alias("is_generic"))


def link_summary(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Totals: valid links with repeats, orphans, dead ends, weakly linked pages."""
    ids = pages.select("page_id").distinct()
    valid = links.join(ids.withColumnRenamed("page_id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("page_id", "target_id"), "target_id", "left_semi")
    flags = link_graph(pages, links).agg(*[F.count_if(f"is_{c}").alias(f"{c}_pages") for c in ("orphan", "dead_end", "weak")])
    total = valid.agg(F.count(F.lit(1)).alias("total_links"))
    return flags.withColumn("total_links", total.scalar()).select("total_links", "orphan_pages", "dead_end_pages", "weak_pages")


def _site_issue(page: str, code: str, severity: str, category: str, detail: Column) -> list[Column]:
    return [F.col(page).alias("page_id"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(category).alias("category"), detail.cast("string").alias("detail")]


def _lowest(rows: DataFrame, by: str, value: str, k: int) -> DataFrame:
    """The ``k`` lowest distinct values of each group; a group is cut down before and behind its shuffle, so none is gathered whole."""
    distinct = rows.select(by, value).distinct()
    ranked = distinct.withColumn("_k", F.row_number().over(W.partitionBy(by).orderBy(value))).filter(F.col("_k") <= k)
    return ranked.groupBy(by).agg(F.array_sort(F.collect_list(value)).alias("lowest"))


def graph_issues(graph: DataFrame) -> DataFrame:
    """ORPHAN_PAGE and DEAD_END_PAGE findings."""
    orphans = graph.filter("is_orphan").select(*_site_issue("page_id", "ORPHAN_PAGE", "High", "InternalLinks", F.col("in_degree")))
    return orphans.unionByName(graph.filter("is_dead_end").select(*_site_issue("page_id", "DEAD_END_PAGE", "Medium", "InternalLinks", F.col("out_degree"))))


def generic_anchor_issues(links: DataFrame) -> DataFrame:
    """One finding per source page with generic link texts, with their number and three samples."""
    generic = links.filter(is_generic_anchor(F.col("anchor")))
    counts = generic.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    found = counts.join(_lowest(generic, "source_id", "anchor", 3), "source_id").withColumnRenamed("lowest", "samples")
    return found.select(*_site_issue("source_id", "GENERIC_ANCHOR_TEXT", "Low", "InternalLinks", F.concat_ws(": ", F.col("n").cast("string"), F.array_join("samples", ", "))))


def duplicate_titles(pages: DataFrame) -> DataFrame:
    """A finding for each page whose trimmed title, case aside, another page has; up to three of the others."""
    titled = pages.filter(~blank(F.col("title"))).withColumn("key", F.lower(utrim(F.col("title"))))
    # Four of a group are enough to show three others to any page of it.
    shared = titled.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = titled.join(shared, "key").join(_lowest(titled, "key", "url", 4).withColumnRenamed("lowest", "urls"), "key")
    others = F.slice(F.filter("urls", lambda u: u != F.col("url")), 1, 3)
    return rows.select(*_site_issue("page_id", "DUPLICATE_TITLE_TAG", "High", "OnPage", F.array_join(others, ", ")))
