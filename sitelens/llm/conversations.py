"""Structure repair of conversations by Hirschberg's divide and conquer.

A repaired conversation is empty, or an optional system turn and then pairs of
user and assistant.  That is an automaton of four states (start, system, user,
assistant), and every row of a conversation a step of edits between them:
keep, re-role, delete, and inserts in front.  Forward costs from the left and
backward costs from the right, four numbers each, meet in the middle; of the
crossings with the least sum the one on the ASCII-least audit is taken, and
both halves recur with the crossing as their end and start.  No table of all
rows and states is kept.

Rows are range-partitioned by conversation and turn, so a conversation of any
length spreads over tasks.  Runs of at most ``BLOCK`` rows become one short
string of row kinds each; what they cost between all states is a matrix of 16
numbers.  The conversations that were cut are put together by the same meeting
of costs on the matrices, level by level if there are many.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.durable import Scratch, small_batches

#: Rows of a block are at most 2 to this power, and so are blocks put together at a time.
BLOCK_BITS = FAN_BITS = 12
START, SYSTEM, USER, ASSISTANT = range(4)
NEVER = 1 << 40
INSERT = REROLE = TRUNCATED = 3
DELETE = 4
#: What ending in a state costs: a user without answer gets one, a lone system turn both.
FINAL = [0, 2 * INSERT, INSERT, 0]
_INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_LETTERS = "-sua"
_LEGAL = ("su", "ua", "au")
_BLANK = r"^[\x20\x09-\x0D]*\z"
_ENDED = r"[.!?][\x20\x09-\x0D]*\z"
_INTS = "array<bigint>"
_SUMMARY = "struct<m:array<bigint>,first:string,last:string,illegal:bigint,turns:bigint,low:bigint,high:bigint>"


class Repaired(NamedTuple):
    """``conversations``: a row each; ``rows``: the repaired rows in order of (position, part), with their edit."""

    conversations: DataFrame
    rows: DataFrame


def _after(state: int, role: int) -> int | None:
    """The state after a turn of a role, if the order of roles allows it."""
    ok = state == START if role == SYSTEM else state == USER if role == ASSISTANT else state != USER
    return role if ok else None


def _next_role(state: int) -> int:
    """The role that a re-roled or inserted turn gets."""
    return ASSISTANT if state == USER else USER


def _edits(kind: str, state: int) -> list[tuple[str, int, int]]:
    """Edits of a row, inserts aside, in ASCII order: (edit, state after it, cost).  Small letters are sound rows, capitals truncated ones."""
    found = [("D", state, DELETE)]
    if kind == "-":
        return found
    extra = TRUNCATED if kind.isupper() else 0
    role = _INITIALS.get(kind.lower())
    kept = None if role is None else _after(state, role)
    if kept is not None:
        found.append(("K", kept, extra))
    found.append(("R", _next_role(state), REROLE + extra))
    return found


def _closed(costs: list[int]) -> list[int]:
    """Costs to go before a row, with inserts in front of it allowed."""
    out = list(costs)
    for _ in range(2):
        out = [min(out[s], INSERT + out[_next_role(s)]) for s in range(4)]
    return out


def _step(kind: str) -> list[list[int]]:
    """Costs of a row from each state to each state, inserts in front included."""
    out = []
    for end in range(4):
        goal = [0 if t == end else NEVER for t in range(4)]
        out.append(_closed([min(cost + goal[t] for _, t, cost in _edits(kind, s)) for s in range(4)]))
    return [[min(out[end][s], NEVER) for end in range(4)] for s in range(4)]


STEPS = {kind: _step(kind) for kind in "suaxSUAX-"}


def forward(kinds: str, costs: list[int]) -> list[int]:
    for kind in kinds:
        step = STEPS[kind]
        costs = [min(costs[0] + step[0][t], costs[1] + step[1][t], costs[2] + step[2][t], costs[3] + step[3][t]) for t in range(4)]
    return costs


def backward(kinds: str, costs: list[int]) -> list[int]:
    for kind in reversed(kinds):
        costs = [min(a + costs[0], b + costs[1], c + costs[2], d + costs[3]) for a, b, c, d in STEPS[kind]]
    return costs


def matrix(kinds: str) -> list[int]:
    """Costs of a run of rows from each state to each state."""
    rows = [forward(kinds, [0 if t == s else NEVER for t in range(4)]) for s in range(4)]
    return [min(x, NEVER) for row in rows for x in row]


def _inserts(state: int, to_go: list[int], want: int) -> tuple[str, int]:
    """Inserts until going on without one costs what is wanted."""
    made = ""
    while to_go[state] != want:
        state, want = _next_role(state), want - INSERT
        made += "I" + _LETTERS[state]
    return made, state


def solve(kinds: str, start: int, ends: list[int]) -> tuple[list[str], int]:
    """Edits of each row on the audit-least of the cheapest paths, and the state at the end.

    ``ends`` says what each state costs behind the last row.  The edits of a
    row are pairs of letters: the edit and the role, ``-`` if deleted.
    """
    if len(kinds) == 1:
        edits = {s: _edits(kinds, s) for s in range(4)}
        plain = [min(cost + ends[t] for _, t, cost in edits[s]) for s in range(4)]
        done, state, open_cost = "", start, _closed(plain)
        while True:
            want = open_cost[state]
            best = next((e for e in edits[state] if e[2] + ends[e[1]] == want), None)
            # D comes before I, and I before K and R.
            if best and (best[0] == "D" or INSERT + open_cost[_next_role(state)] != want):
                edit, end, _ = best
                return [done + edit + ("-" if edit == "D" else _LETTERS[end])], end
            state = _next_role(state)
            done += "I" + _LETTERS[state]
    middle = len(kinds) // 2
    come = forward(kinds[:middle], [0 if t == start else NEVER for t in range(4)])
    go = backward(kinds[middle:], ends)
    least = min(c + g for c, g in zip(come, go, strict=True))
    # Crossings off the cheapest paths are closed; among several the left half finds the one of the least audit.
    crossings = [g if c + g == least else NEVER for c, g in zip(come, go, strict=True)]
    left, crossing = solve(kinds[:middle], start, crossings)
    right, end = solve(kinds[middle:], crossing, ends)
    return left + right, end


def solved(kinds: str, start: int, ends: list[int], last: bool) -> tuple[list[str], int]:
    """As ``solve``, with the turns inserted behind the last row of a conversation."""
    steps, end = solve(kinds, start, ends)
    if last:
        made, end = _inserts(end, [0, NEVER, NEVER, 0], FINAL[end])
        steps[-1] += made
    return steps, end


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise("x")


def _summary(initials: str, kinds: str, turns: list[int | None]) -> dict:
    known = [t for t in turns if t is not None]
    illegal = sum(initials[i : i + 2] not in _LEGAL for i in range(len(initials) - 1))
    return {"m": matrix(kinds), "first": initials[0], "last": initials[-1], "illegal": illegal, "turns": len(set(known)), "low": min(known, default=None), "high": max(known, default=None)}


def _joined(parts: list) -> dict:
    """The summary of consecutive runs."""
    out = None
    for x in parts:
        if out is None:
            out = {k: x[k] for k in ("m", "first", "last", "illegal", "turns", "low", "high")}
            continue
        m = out["m"]
        out["m"] = [min(NEVER, *(m[4 * s + c] + x["m"][4 * c + t] for c in range(4))) for s in range(4) for t in range(4)]
        out["illegal"] += x["illegal"] + (out["last"] + x["first"] not in _LEGAL)
        out["turns"] += x["turns"] - (x["low"] is not None and x["low"] == out["high"])
        out["last"] = x["last"]
        if x["low"] is not None:
            out["low"], out["high"] = x["low"] if out["low"] is None else out["low"], x["high"]
    return out


def _ends_of(parts: list, ends: list[int]) -> list[list[int]]:
    """What each state costs behind each of consecutive runs."""
    out = [ends]
    for m in reversed(parts[1:]):
        ends = [min(m[4 * s + t] + ends[t] for t in range(4)) for s in range(4)]
        out.append(ends)
    return out[::-1]


def _starts_of(parts: list[list[int]], start: int) -> list[int]:
    """The state in which each of consecutive runs starts; a run's part leads from each start to its end."""
    out = [start]
    for ends in parts[:-1]:
        out.append(ends[out[-1]])
    return out


def _through(parts: list[list[int]]) -> list[int]:
    """Where consecutive runs lead from each start."""
    found = list(range(4))
    for ends in parts:
        found = [ends[s] for s in found]
    return found


def _put_together(scratch: Scratch, blocks: DataFrame, fan_bits: int) -> tuple[DataFrame, DataFrame]:
    """Blocks (conv, block, kinds, summary) of cut conversations with start, ends and last; and the conversations' summaries."""
    joined = F.udf(_joined, _SUMMARY, useArrow=True)
    ends_of = F.udf(_ends_of, "array<array<bigint>>", useArrow=True)
    starts_of = F.udf(_starts_of, _INTS, useArrow=True)
    through = F.udf(_through, _INTS, useArrow=True)
    ends_from = F.udf(lambda kinds, ends: [solve(kinds, s, list(ends))[1] for s in range(4)], _INTS, useArrow=True)

    low, levels = blocks.select("conv", "block", "summary"), []
    while True:
        most = low.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= 1:
            break
        # Consecutive blocks, at most as many as the bits count; all of a conversation as soon as they are that few.
        above = F.shiftright("block", fan_bits) if most > 1 << fan_bits else F.lit(0).cast("bigint")
        kids = low.groupBy("conv", above.alias("above")).agg(F.array_sort(F.collect_list(F.struct("block", "summary"))).alias("kids"))
        kids = scratch.save(kids.withColumn("summary", joined(F.col("kids.summary"))), f"level{len(levels)}")
        levels.append(kids)
        low = kids.select("conv", F.col("above").alias("block"), "summary")
    summaries = low.select("conv", "summary")

    # Downwards: what lies behind each block costs from each state.
    ends = low.select("conv", "block", F.lit(FINAL).cast(_INTS).alias("ends"), F.lit(True).alias("last"))
    for kids in reversed(levels):
        at = kids.withColumnRenamed("above", "block").join(ends, ["conv", "block"])
        at = at.select("conv", F.posexplode(F.zip_with("kids.block", ends_of(F.col("kids.summary.m"), "ends"), lambda b, e: F.struct(b.alias("block"), e.alias("ends")))).alias("i", "kid"), (F.size("kids") - 1).alias("n"), "last")
        ends = at.select("conv", "kid.block", "kid.ends", (F.col("last") & (F.col("i") == F.col("n"))).alias("last"))
    placed = scratch.save(blocks.join(ends, ["conv", "block"]).withColumn("leads", ends_from("kinds", "ends")), "placed")

    # Upwards: where each block leads from each start; then downwards: where it does start.
    leads, own = placed.select("conv", "block", "leads"), []
    for depth, _ in enumerate(levels):
        above = F.shiftright("block", fan_bits) if depth < len(levels) - 1 else F.lit(0).cast("bigint")
        kids = leads.groupBy("conv", above.alias("above")).agg(F.array_sort(F.collect_list(F.struct("block", "leads"))).alias("kids"))
        own.append(scratch.save(kids.withColumn("leads", through(F.col("kids.leads"))), f"leads{depth}"))
        leads = own[-1].select("conv", F.col("above").alias("block"), "leads")
    starts = leads.select("conv", "block", F.lit(START).cast("bigint").alias("start"))
    for kids in reversed(own):
        at = kids.withColumnRenamed("above", "block").join(starts, ["conv", "block"])
        starts = at.select("conv", F.explode(F.zip_with("kids.block", starts_of(F.col("kids.leads"), "start"), lambda b, s: F.struct(b.alias("block"), s.alias("start")))).alias("kid")).select("conv", "kid.block", "kid.start")
    return placed.drop("leads").join(starts, ["conv", "block"]), summaries


def repair(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    block_bits: int = BLOCK_BITS,
    fan_bits: int = FAN_BITS,
) -> Repaired:
    """Cheapest repairs of conversations.

    Returns (conversations, rows).  Of each conversation: ``conv_col``, gaps,
    blank, duplicate, truncated, illegal, cost, audit.  Of each repaired row:
    ``conv_col``, position and part, by which the rows of a conversation are
    ordered, edit (K, R or I), role, text.

    * rows of one turn are taken in the order of role and SHA-256 of text;
      repeated rows stand side by side;
    * null turn: before all others; null conversation: one of its own; null
      role or text: one space;
    * equal texts are told by SHA-256; very long texts and conversations are
      processed whole;
    * empty table: empty results; other columns, whatever their names, are ignored.
    """
    spark = rows.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "conversations")
    text = F.coalesce(F.col(text_col), F.lit(" "))
    source = rows.select(
        F.struct(F.col(conv_col).alias("id")).alias("conv"),
        F.col(turn_col).cast("bigint").alias("turn"),
        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
        F.sha2(text, 256).alias("digest"),
        text.alias("text"),
        # Equal rows may change places, so a number spreads them.
        F.pmod(F.monotonically_increasing_id(), F.lit(1024)).alias("spread"),
    )
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "digest", "spread"]
    ordered = source.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = scratch.save(ordered.withColumn("position", F.monotonically_increasing_id()).drop("spread"), "ordered")
    ordered = ordered.withColumn("block", F.shiftright("position", block_bits))

    narrow = ordered.select("conv", "block", "position", "turn", "role", "digest", F.col("text").rlike(_BLANK).alias("blank"), (~F.col("text").rlike(_ENDED)).alias("open"))
    firsts = narrow.groupBy("conv", "role", "digest").agg(F.min("position").alias("position")).select("position", F.lit(True).alias("first"))
    judged = narrow.join(firsts, "position", "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("open"), "truncated")
    judged = judged.withColumn("fault", fault).withColumn("initial", _initial(F.col("role")))
    kind = F.when(F.col("fault").isin("blank", "duplicate"), "-").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    in_order = F.array_sort(F.collect_list(F.struct("position", kind.alias("kind"), "initial", "turn")))
    counts = [F.count(F.when(F.col("fault") == name, 1)).alias(name) for name in ("blank", "duplicate", "truncated")]
    blocks = judged.groupBy("conv", "block").agg(in_order.alias("seen"), F.min("position").alias("begin"), *counts)
    summary = F.udf(_summary, _SUMMARY, useArrow=True)
    blocks = blocks.select(
        "conv", "block", "begin", "blank", "duplicate", "truncated", F.array_join("seen.kind", "").alias("kinds"),
        summary(F.array_join("seen.initial", ""), F.array_join("seen.kind", ""), F.col("seen.turn")).alias("summary"),
    )
    blocks = scratch.save(blocks, "blocks")

    cut = scratch.save(blocks.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("conv"), "cut")
    whole = blocks.join(cut, "conv", "left_anti")
    summaries = whole.select("conv", "summary")
    whole = whole.withColumns({"ends": F.lit(FINAL).cast(_INTS), "last": F.lit(True), "start": F.lit(START).cast("bigint")})
    if not cut.isEmpty():
        split, own = _put_together(scratch, blocks.join(cut, "conv", "left_semi"), fan_bits)
        whole, summaries = whole.unionByName(split), summaries.unionByName(own)
    steps = F.udf(lambda kinds, start, ends, last: solved(kinds, start, list(ends), last)[0], "array<string>", useArrow=True)
    done = scratch.save(whole.withColumn("steps", steps("kinds", "start", "ends", "last")).drop("summary", "start", "ends", "last"), "done")

    audit = F.regexp_replace(F.array_join("steps", ""), "(.).", "$1")
    edits = lambda letter: F.length(audit) - F.length(F.translate(audit, letter, ""))
    kept_open = F.size(F.filter(F.zip_with(F.split("kinds", ""), "steps", lambda kind, step: kind.isin("S", "U", "A", "X") & ~step.contains("D-")), lambda x: x))
    cost = (DELETE * edits("D") + REROLE * edits("R") + INSERT * edits("I") + TRUNCATED * kept_open).cast("bigint")
    sums = done.groupBy("conv").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")], F.sum(cost).alias("cost"), F.array_join(F.array_sort(F.collect_list(F.struct("block", audit.alias("audit")))).getField("audit"), "").alias("audit")
    )
    gaps = F.coalesce(F.col("summary.high") - F.col("summary.low") + 1 - F.col("summary.turns"), F.lit(0))
    per_conversation = summaries.join(sums, "conv").select(
        F.col("conv.id").alias(conv_col), gaps.alias("gaps"), "blank", "duplicate", "truncated", F.col("summary.illegal").alias("illegal"), "cost", "audit"
    )
    step = F.element_at("steps", (F.col("position") - F.col("begin") + 1).cast("int"))
    parts = ordered.select("conv", "block", "position", "role", "text").join(done.select("conv", "block", "begin", "steps"), ["conv", "block"])
    parts = parts.select("conv", "position", "role", "text", F.posexplode(F.regexp_extract_all(step, F.lit("(..)"), F.lit(1))).alias("part", "pair"))
    parts = parts.withColumns({"edit": F.substring("pair", 1, 1), "given": F.when(F.substring("pair", 2, 1) == "u", "user").otherwise("assistant")}).filter("edit != 'D'")
    repaired = parts.select(
        F.col("conv.id").alias(conv_col), "position", "part", "edit",
        F.when(F.col("edit") == "K", F.col("role")).otherwise(F.col("given")).alias("role"), F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"),
    )
    return Repaired(per_conversation, repaired)


def digests(repaired: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """SHA-256 of each conversation's ``role:text`` lines, joined by newlines.

    A digest takes its bytes in order, so a conversation is read by one task,
    row by row: nothing but the state of its digest is held.
    """
    lines = repaired.select(F.struct(F.col(conv_col).alias("id")).alias("conv"), "position", "part", F.concat("role", F.lit(":"), "text").alias("line"))
    lines = lines.repartition("conv").sortWithinPartitions("conv", "position", "part").select("conv", "line")
    kind = lines.schema["conv"].dataType["id"].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("repaired_sha256", T.StringType())])
    arrow = pa.schema([lines.limit(0).toArrow().schema.field("conv").type.field("id"), pa.field("repaired_sha256", pa.string())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_id, digest, done = None, None, []
        for batch in batches:
            for conv, line in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                if digest is None or conv["id"] != open_id:
                    if digest is not None:
                        done.append((open_id, digest.hexdigest()))
                    open_id, digest = conv["id"], sha256(line)
                else:
                    digest.update(b"\n")
                    digest.update(line)
            yield _batch(done, arrow)
            done = []
        if digest is not None:
            yield _batch([(open_id, digest.hexdigest())], arrow)

    return lines.mapInArrow(hashed, schema).withColumnRenamed("id", conv_col)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) with known faults, chosen by the CRC-32 of ``conv_id:turn``; nulls are one space there and in role and text.

    Of 20 rows one is dropped, one loses its text, one its marks of an end, one is repeated and one gets the role of a user.
    """
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn"))) % 20
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace(named("text"), "[.!?]", "")).otherwise(named("text"))
    times = F.when(F.col("fault") == 0, F.array()).when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.withColumn("fault", fault).select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(named("role")).alias("role"), text.alias("text"), F.explode(times.cast("array<int>")).alias("copy")).drop("copy")
