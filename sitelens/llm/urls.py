"""URL filters: a Bloom filter cascade gives exact membership of rules without joins.

A rule is a host and a path prefix.  The keys of an URL are its host suffixes
combined with the path prefixes whose lengths some rule has; the corpus's key
universe is the set of all such keys.  Level 1 of a cascade encodes the listed
keys; every further level encodes what the level before let through wrongly:
unlisted keys of the universe on even levels, listed keys on odd ones.  A key of
the universe is listed exactly when the first level that denies it is an even
one (or none denies it and the number of levels is odd).

Level 1 is sized from both counts, the listed keys and the universe, so that it
lets through about as many keys as are listed; every later level is about as
large as the rule list then.  A level is one row holding its words, read through
a scalar subquery.  The keys of every level are counted and checked against
``MAX_KEYS`` before it is gathered; a level that let too many through is built
again with more bits.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.durable import Scratch

#: Each level holds at most this many keys, and at most this many bits (16 MB) travel to each executor.
MAX_KEYS, MAX_BITS = 10_000_000, 1 << 27
#: Bits a key of the levels behind the first, and the most that the first level may take.
BITS_PER_KEY, MOST_BITS_PER_KEY = 10, 80


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://`` up to ``/ ? #``, A-Z lower-cased) and path (up to ``? #``); empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lowered, F.lit("")), F.coalesce(path, F.lit(""))


def url_keys(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """All (host suffix, path prefix) keys of an URL as structs; the prefixes have the given lengths."""
    labels = F.split(host, r"\.")
    suffixes = F.when(
        host != "",
        F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")),
    ).otherwise(F.array().cast("array<string>"))
    lengths = F.filter(F.array(*[F.lit(n) for n in sorted(path_lengths)]), lambda n: n <= F.length(path))
    return F.flatten(
        F.transform(suffixes, lambda s: F.transform(lengths, lambda n: F.struct(s.alias("host"), F.substring(path, F.lit(1), n).alias("path"))))
    )


def _positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key["host"], key["path"], F.lit(level * 101 + j)), F.lit(bits)) for j in range(hashes)]


@dataclass(frozen=True)
class Level:
    words: DataFrame  # one row: words array<bigint>
    bits: int
    number: int
    hashes: int

    def admits(self, key: Column, words: Column) -> Column:
        found = F.lit(True)
        for p in _positions(key, self.number, self.bits, self.hashes):
            word = F.element_at(words, (F.shiftright(p, 6) + 1).cast("int"))
            # The bit is tested by masking; a shift by a column has no function of its own.
            found = found & (word.bitwiseAND(F.element_at(_masks(), (p % 64 + 1).cast("int"))) != 0)
        return found


def _masks() -> Column:
    return F.array(*[F.lit((1 << i) if i < 63 else -(1 << 63)).cast("bigint") for i in range(64)])


def _level(keys: DataFrame, n: int, number: int, bits_per_key: int) -> Level:
    """A level with the given keys (column ``key``)."""
    words = max(1, -(-n * bits_per_key // 64))
    bits = words * 64
    hashes = max(1, min(24, round(bits_per_key * 0.69)))
    if n > MAX_KEYS or bits > MAX_BITS:
        raise ValueError(f"level {number} of the cascade would hold {n} keys in {bits} bits; {MAX_KEYS} keys and {MAX_BITS} bits are allowed: split the list by host suffix")
    set_bits = keys.select(F.explode(F.array(*_positions(F.col("key"), number, bits, hashes))).alias("p")).select(
        F.shiftright("p", 6).alias("word"), F.element_at(_masks(), (F.col("p") % 64 + 1).cast("int")).alias("mask")
    )
    filled = set_bits.groupBy("word").agg(F.bit_or("mask").alias("bits"))
    every = keys.sparkSession.range(words).withColumnRenamed("id", "word").join(filled, "word", "left")
    pairs = F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))))
    row = every.agg(pairs.alias("pairs")).select(F.col("pairs.bits").alias("words"))
    return Level(row, bits, number, hashes)


class Cascade:
    """Exact membership of ``listed`` keys among the keys of ``universe`` (columns ``key``)."""

    def __init__(self, scratch: Scratch, listed: DataFrame, universe: DataFrame, n_universe: int, bits_per_key: int | None = None):
        self.levels: list[Level] = []
        listed = scratch.save(listed.select("key").distinct(), "listed")
        n = n_listed = listed.count()
        others = universe.select("key").join(listed, "key", "left_anti")
        inside, outside = listed, None
        # Each hash halves what passes: so many that about as many unlisted keys pass as there are listed ones.
        each = bits_per_key or max(BITS_PER_KEY, min(MOST_BITS_PER_KEY, math.ceil(1.45 * math.log2(max(2.0, n_universe / max(n, 1)))) + 2))
        while n:
            number = len(self.levels) + 1
            level = _level(inside, n, number, each)
            words = scratch.save(level.words, "level")
            self.levels.append(Level(words, level.bits, number, level.hashes))
            tested = others if outside is None else outside
            passed = tested.withColumn("w", words.scalar()).filter(self.levels[-1].admits(F.col("key"), F.col("w"))).select("key")
            passed = scratch.save(passed.distinct(), "passed")
            n_passed = passed.count()
            if number == 1 and not bits_per_key and n_passed > 2 * n_listed + 1_000 and each < MOST_BITS_PER_KEY:
                self.levels.pop()
                each = min(MOST_BITS_PER_KEY, each + 8)
                continue
            inside, outside, n = passed, inside, n_passed
            each = bits_per_key or BITS_PER_KEY

    def columns(self) -> list[Column]:
        """The levels' words, to be added to the rows that are judged."""
        return [level.words.scalar() for level in self.levels]

    def lists(self, key: Column, words: list[Column]) -> Column:
        """Whether the key of the universe is listed; ``words`` are columns with the levels' words."""
        verdict = F.lit(len(self.levels) % 2 == 1)
        for level, w in reversed(list(zip(self.levels, words, strict=True))):
            verdict = F.when(level.admits(key, w), verdict).otherwise(F.lit(level.number % 2 == 0))
        return verdict


def url_filter(
    pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow", bits_per_key: int | None = None
) -> DataFrame:
    """Judge every URL by the longest rule that fits it.

    A rule fits its host and all subdomains where the path starts with the
    rule's path.  Longest means host and path together; the longer host goes
    before the longer path, and block before allow for the same host and path.
    Returns a row per input row: ``id_col``, host, path, rule (host and path of
    the rule, else null), verdict (the rule's, else ``default``).

    * null url, or one without ``://``: host and path are empty and no rule fits;
    * repeated rows and null ids: judged one by one; very long urls: judged whole;
    * empty table or no rules: an empty result, or ``default`` everywhere;
    * other columns, whatever their names, are ignored.
    """
    spark = pages.sparkSession
    host, path = url_parts(F.col(url_col))
    judged = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    lengths = sorted({len(r.path) for r in rules}) or [0]
    keyed = judged.withColumn("keys", url_keys(F.col("host"), F.col("path"), lengths))
    scratch = Scratch(spark, "urls")
    universe = keyed.select(F.explode("keys").alias("key")).distinct()
    listed = _rule_table(spark, rules)
    n_universe = keyed.select(F.explode("keys").alias("key")).agg(F.approx_count_distinct("key").alias("n")).first()["n"]
    cascades = {v: Cascade(scratch, listed.filter(F.col("verdict") == v), universe, n_universe, bits_per_key) for v in ("block", "allow")}
    columns = {f"w_{v}_{i}": c for v, cascade in cascades.items() for i, c in enumerate(cascade.columns())}
    rows = keyed.withColumns(columns) if columns else keyed

    def best(verdict: str) -> Column:
        words = [F.col(f"w_{verdict}_{i}") for i in range(len(cascades[verdict].levels))]
        fits = F.filter(F.col("keys"), lambda k: cascades[verdict].lists(k, words))
        ranked = F.transform(
            fits,
            lambda k: F.struct(
                (F.length(k["host"]) + F.length(k["path"])).alias("length"),
                F.length(k["host"]).alias("host_length"),
                F.lit(1 if verdict == "block" else 0).alias("wins"),
                F.concat(k["host"], k["path"]).alias("rule"),
            ),
        )
        return F.array_max(ranked)

    chosen = F.greatest(best("block"), best("allow"))
    found = rows.select("id", "host", "path", chosen.alias("best"))
    return found.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.when(F.col("best").isNull(), F.lit(default)).when(F.col("best.wins") == 1, "block").otherwise("allow").alias("verdict"),
    )


def _rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    table = spark.createDataFrame([(r.verdict, r.host, r.path) for r in rules], "verdict string, host string, path string")
    return table.select("verdict", F.struct("host", "path").alias("key"))
