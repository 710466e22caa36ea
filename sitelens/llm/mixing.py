"""Mixing sources to target weights by hierarchical budgeting.

Documents hang below a tree (domain, language, source).  A budget of tokens
flows from the root: at each node it is shared among the children by weight; a
child that holds less than its share takes all it holds, and the shortage goes
to its siblings by their weights.  Only what all children of a node together
cannot take is missing there, and goes to the node's own siblings, since a
node never holds more than its children do.  Each leaf then takes the longest
prefix of its seeded epochs that fits its budget: whole epochs first, then the
start of one more.

Shares are whole numbers of tokens, computed in exact decimals; fractions are
dropped.  Only sums by leaf and by order bucket are ever ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.durable import Scratch

#: Documents of a leaf for each order bucket, about: the leaf is cut by hex digits of the order key.
BUCKET_DOCS = 1_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def share_out(children: DataFrame, parent: list[str]) -> DataFrame:
    """Adds ``share`` to children (columns of ``parent``, name, weight, holds, budget of the parent)."""
    big = "decimal(25,0)"
    by_parent = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    order = by_parent.orderBy(F.col("holds").cast("double") / F.col("weight"), "name")
    before = F.coalesce(F.sum("holds").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    # Exact comparison of holds / weight with what is left over the weights that are left.
    full = F.col("holds").cast(big) * F.col("rest").cast("decimal(12,0)") <= (F.col("budget").cast(big) - F.col("before").cast(big)) * F.col("weight").cast("decimal(12,0)")
    marked = children.withColumn("before", before).withColumn("rest", rest).withColumn("full", full)
    taken = F.coalesce(F.sum(F.when(F.col("full"), F.col("holds"))).over(by_parent), F.lit(0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(by_parent)
    summed = marked.withColumn("taken", taken).withColumn("open_weight", open_weight)
    part = F.expr("cast((budget - taken) as decimal(25,0)) * cast(weight as decimal(12,0)) div cast(open_weight as decimal(12,0))")
    return summed.withColumn("share", F.when(F.col("full"), F.col("holds")).otherwise(part)).drop("before", "rest", "full", "taken", "open_weight")


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: dict[tuple[str, ...], int], budget: Column, epochs: int) -> DataFrame:
    """Leaves (level columns, tokens, docs) with ``leaf_budget``; ``budget`` is a column over the sum ``total``."""
    node = leaves.withColumn("holds", F.col("tokens") * epochs)
    node = node.withColumn("total", leaves.agg(F.sum("tokens")).scalar())
    node = node.withColumn("budget", F.least(budget.cast("bigint"), F.col("total") * epochs))
    for depth in range(1, len(levels) + 1):
        path, parent = levels[:depth], levels[: depth - 1]
        children = node.groupBy(*path).agg(F.sum("holds").alias("holds"), F.first("budget").alias("budget"))
        weight = F.lit(1)
        for names, value in weights.items():
            if len(names) == depth:
                match = F.lit(True)
                for column, name in zip(path, names, strict=True):
                    match = match & (F.lit(True) if name == "*" else F.col(column) == name)
                weight = F.when(match, value).otherwise(weight)
        children = children.withColumn("weight", weight.cast("bigint")).withColumn("name", F.col(path[-1]))
        shares = share_out(children, parent).select(*path, F.col("share").alias("_share"))
        node = node.join(shares, path).withColumn("budget", F.col("_share")).drop("_share")
    return node.select(*levels, "tokens", "docs", F.col("budget").alias("leaf_budget"))


def mix(
    docs: DataFrame,
    levels: dict[str, Column],
    weights: dict[tuple[str, ...], int],
    budget: Column,
    epochs: int = 1,
    seed: int = 0,
    tokens: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """How often each document is taken: ``id_col``, the columns named in ``keep``, the levels, n_tokens, leaf_budget, copies.

    ``levels`` names the tree's columns from the top, ``weights`` gives whole
    weights of node paths (``*`` stands for any name; 1 where none is given, the
    last match wins), ``budget`` is an expression over ``total`` (tokens of all
    documents), ``epochs`` the most copies of a document.  In each epoch a
    leaf's order is that of md5(seed:epoch:id).

    * null text: no tokens, taken with any prefix it lies in; null level: the
      node named by the empty string; null id: ordered as the empty string;
    * rows that repeat an id share its place: all or none of them are taken;
      other ties don't occur, since orders are digests of ids;
    * very long texts: counted whole; one that is longer than what is left of
      its leaf's budget ends the leaf's prefix;
    * a budget beyond what the documents hold: everything is taken ``epochs`` times;
    * empty table: empty result; other columns, whatever their names, are ignored.
    """
    names = list(levels)
    scratch = Scratch(docs.sparkSession, "mixing")
    counted = docs.select(
        F.col(id_col).alias("id"),
        *keep,
        *[F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in levels.items()],
        (word_count(F.col(text_col)) if tokens is None else tokens.cast("bigint")).alias("n_tokens"),
    )
    counted = scratch.save(counted, "counted")
    leaves = scratch.save(counted.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "leaves")
    planned = leaf_budgets(leaves, names, weights, budget, epochs)
    planned = planned.withColumn("whole", F.when(F.col("tokens") > 0, F.expr("leaf_budget div tokens")).otherwise(F.lit(epochs)).cast("int"))
    planned = planned.withColumn("left", F.col("leaf_budget") - F.col("whole") * F.col("tokens"))
    digits = F.ceil(F.log(16.0, F.greatest(F.col("docs") / BUCKET_DOCS, F.lit(1.0)))).cast("int")
    planned = scratch.save(planned.withColumn("digits", F.least(digits, F.lit(8))).drop("tokens", "docs"), "planned")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    rows = counted.join(planned, names).withColumn("key", key).withColumn("part", F.col("key").substr(F.lit(1), F.col("digits")))
    parts = rows.groupBy(*names, "part").agg(F.sum("n_tokens").alias("held"), F.first("left").alias("limit"))
    upto = F.sum("held").over(W.partitionBy(*names).orderBy("part").rowsBetween(W.unboundedPreceding, 0))
    parts = parts.withColumn("upto", upto).select(
        *names, "part", (F.col("upto") - F.col("held")).alias("before"), (F.col("upto") <= F.col("limit")).alias("all_in"), (F.col("upto") - F.col("held") > F.col("limit")).alias("none_in")
    )
    placed = rows.join(parts, [*names, "part"])
    sure = placed.filter("all_in or none_in").withColumn("more", F.col("all_in"))
    # Only the part of a leaf in which its budget ends is ordered document by document.
    cut = placed.filter("not all_in and not none_in")
    seen = F.sum("n_tokens").over(W.partitionBy(*names, "part").orderBy("key", "id"))
    cut = cut.withColumn("more", F.col("before") + seen <= F.col("left"))
    out = sure.unionByName(cut)
    copies = F.least(F.col("whole") + F.col("more").cast("int"), F.lit(epochs)).cast("bigint")
    return out.select(F.col("id").alias(id_col), *keep, *names, "n_tokens", "leaf_budget", copies.alias("copies"))
