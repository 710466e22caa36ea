"""Robots files as tables, and URL admission: frontier expansion, access, delays, policy."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import utrim
from ..functions.urls import has_user_info, host, host_matches, is_http, is_wildcard_query, normalize_url, path, query
from ..plans.durable import small_batches
from .rule_trie import RuleTrie

#: Longest crawl delay that is believed, in seconds.
MAX_DELAY = 300
#: Addresses of one host and agent that are judged together, about.
PART_URLS = 50_000


def robots_policy(fetches: DataFrame) -> DataFrame:
    """How a fetched robots file (status) is to be used; failed fetches have a null status."""
    s = F.col("status")
    policy = (
        F.when(s.between(200, 299), "parse").when(s.isin(401, 403), "disallow_all")
        .when(s.isNull() | (s == 429) | (s >= 500), "unavailable").otherwise("allow_all")
    )
    return fetches.withColumn("policy", policy)


def robots_lines(robots: DataFrame) -> DataFrame:
    """Lines of robots files (host, body): field, value and the group a line belongs to."""
    lines = robots.select("host", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("n", "raw"))
    clean = utrim(F.regexp_replace("raw", "#.*$", ""))
    rows = lines.withColumn("line", clean).withColumn("field", F.lower(utrim(F.regexp_extract("line", r"^([^:]*):", 1)))).withColumn("value", utrim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1)))
    kind = F.when(F.col("line") == "", "blank").when(F.col("field") == "user-agent", "agent").when(F.col("field").isin("allow", "disallow", "crawl-delay"), "rule")
    rows = rows.withColumn("kind", kind)
    # An agent line opens a group unless the line that counts before it is an agent line too.
    by_line = W.partitionBy("host").orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    before = F.last("kind", ignorenulls=True).over(by_line)
    starts = (F.col("kind") == "agent") & F.coalesce(before != "agent", F.lit(True))
    upto = W.partitionBy("host").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    group = F.sum(F.when(starts, 1).otherwise(0)).over(upto)
    rows = rows.withColumn("group", group)
    # A blank line ends the group: rules behind it belong to nobody.
    in_group = W.partitionBy("host", "group").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    open_ = (F.col("group") > 0) & (F.sum(F.when(F.col("kind") == "blank", 1).otherwise(0)).over(in_group) == 0)
    return rows.withColumn("open", open_)


def robots_rules(robots: DataFrame) -> DataFrame:
    """(host, group, agent, allow, pattern, delay): each rule for each agent of its group; agents without rules have null patterns."""
    lines = robots_lines(robots).filter("open")
    agents = lines.filter("kind = 'agent' and value <> ''").select("host", "group", F.lower("value").alias("agent"))
    rules = lines.filter("field in ('allow', 'disallow') and value <> ''").select("host", "group", (F.col("field") == "allow").alias("allow"), F.col("value").alias("pattern"))
    seconds = F.col("value").try_cast("double")
    delays = lines.filter("field = 'crawl-delay'").withColumn("delay", seconds).filter(F.col("delay").between(0, MAX_DELAY)).groupBy("host", "group").agg(F.min("delay").alias("delay"))
    return agents.join(rules, ["host", "group"], "left").join(delays, ["host", "group"], "left")


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    return robots_lines(robots).filter("field = 'sitemap' and value <> ''").select("host", F.col("value").alias("sitemap")).distinct()


def robots_clean_params(robots: DataFrame) -> DataFrame:
    return robots_lines(robots).filter("field = 'clean-param' and value <> ''").select("host", F.col("value").alias("clean_param")).distinct()


def _best_groups(asked: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules of the groups that match an asked agent best: a star is worth 0, a substring its length."""
    worth = F.when(F.col("agent") == "*", 0).when(F.lower("user_agent").contains(F.col("agent")), F.length("agent"))
    matched = asked.select("host", "user_agent").distinct().join(rules, "host").withColumn("worth", worth).filter("worth is not null")
    best = matched.groupBy("host", "user_agent").agg(F.max("worth").alias("worth"))
    return matched.join(best, ["host", "user_agent", "worth"])


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of host, agent and part, the rules of each ahead of its addresses, to addresses with ``allowed``."""
    at, trie = None, None
    for batch in batches:
        names = batch.schema.names
        column = lambda name: batch.column(names.index(name)).to_pylist()  # noqa: B023, E731
        rules, keep, allowed = column("_rules"), [], []
        for i, key in enumerate(zip(column("host"), column("user_agent"), column("_part"), strict=True)):
            if key != at:
                at, trie = key, None
            if rules[i] is not None:
                trie = RuleTrie((r["allow"], r["pattern"]) for r in rules[i])
            else:
                keep.append(i)
                target = batch.column(names.index("_target"))[i].as_py()
                allowed.append(trie is None or target is None or trie.allows(target))
        rows = batch.take(pa.array(keep, pa.int64())).select([n for n in names if not n.startswith("_")])
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(allowed, pa.bool_())], [*rows.schema.names, "allowed"])


def robots_allowed(urls: DataFrame, rules: DataFrame, policies: DataFrame | None = None) -> DataFrame:
    """Whether each URL (host, user_agent, url) may be fetched: the longest matching rule wins, allow wins ties.

    The rules of a host and agent are one row, and its addresses follow it
    through a partition in parts of at most ``PART_URLS`` about, each with a copy
    of the rules: a row out for every row in, one trie held at a time.

    ``policies`` (host, policy, see ``robots_policy``) overrules the rules: no
    address of a host that disallows all or cannot be asked now may be fetched,
    and any address of one without a robots file.
    """
    small_batches(urls.sparkSession, rows=5_000)
    best = _best_groups(urls, rules).filter("pattern is not null").groupBy("host", "user_agent").agg(F.collect_set(F.struct("allow", "pattern")).alias("_rules"))
    # Few hosts have that many addresses: fewer than all addresses by that number.
    many = urls.groupBy("host", "user_agent").agg(F.ceil(F.count(F.lit(1)) / PART_URLS).cast("int").alias("_parts")).filter("_parts > 1")
    parts = F.coalesce("_parts", F.lit(1))
    target = F.concat(path(F.col("url")), F.when(query(F.col("url")) != "", F.concat(F.lit("?"), query(F.col("url")))).otherwise(""))
    asked = urls.join(many, ["host", "user_agent"], "left").select(*urls.columns, target.alias("_target"), F.pmod(F.xxhash64("url"), parts).cast("int").alias("_part"), F.lit(None).cast(best.schema["_rules"].dataType).alias("_rules"))
    copies = best.join(many, ["host", "user_agent"], "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    order = ["host", "user_agent", "_part"]
    rows = asked.unionByName(copies, allowMissingColumns=True).repartition(*order).sortWithinPartitions(*order, F.isnull("_rules"))
    judged = rows.mapInArrow(_judged, T.StructType([*urls.schema.fields, T.StructField("allowed", T.BooleanType())]))
    if policies is None:
        return judged
    by_policy = F.when(F.col("policy").isin("disallow_all", "unavailable"), F.lit(False)).when(F.col("policy") == "allow_all", F.lit(True))
    return judged.join(policies.select("host", "policy"), "host", "left").withColumn("allowed", F.coalesce(by_policy, "allowed")).drop("policy")


def crawl_delay(asked: DataFrame, rules: DataFrame) -> DataFrame:
    """Smallest delay among the best matching groups of each (host, user_agent)."""
    found = _best_groups(asked, rules).groupBy("host", "user_agent").agg(F.min("delay").alias("delay"))
    return asked.select("host", "user_agent").distinct().join(found, ["host", "user_agent"], "left")


def admitted_urls(links: DataFrame, max_depth: int = 8, subdomains: bool = False) -> DataFrame:
    """Links (crawl_id, target_url, depth, project_host) that a crawl may follow: crawl_id, normalized_url, depth of the target."""
    target = F.col("target_url")
    domain, wanted = host(target), F.lower("project_host")
    fits = host_matches(domain, wanted) if subdomains else domain == wanted
    admitted = links.filter(is_http(target) & ~has_user_info(target) & fits & ~is_wildcard_query(target) & (F.col("depth") + 1 <= max_depth))
    return admitted.select("crawl_id", normalize_url(target).alias("normalized_url"), (F.col("depth") + 1).alias("depth")).filter("normalized_url is not null")


def discover_urls(links: DataFrame, known: DataFrame, max_depth: int = 8, subdomains: bool = False) -> DataFrame:
    """New URLs of admitted links: normalised, not known; the smallest depth stays."""
    first = admitted_urls(links, max_depth, subdomains).groupBy("crawl_id", "normalized_url").agg(F.min("depth").alias("depth"))
    return first.join(known.select("crawl_id", "normalized_url").distinct(), ["crawl_id", "normalized_url"], "left_anti")
