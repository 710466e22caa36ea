"""Toxicity, conversation repair and the audit of filters: brute force, held-out labels and awkward rows."""

import hashlib
import itertools
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sitelens.llm import conversations, filters, toxicity
from sitelens.llm.conversations import damaged, digests, repair, solve, solved
from sitelens.llm.filters import filter_masks, interactions
from sitelens.llm.tries import Trie

GAP = r"[^\x20\x09-\x0D]+"
RNG = random.Random(11)


# Conversation repair


def cheapest(kinds):
    """Least (cost, audit) with its edits, over all paths at once: every state's best text is kept whole."""
    move = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

    def inserted(best):
        best = dict(best)
        for _ in range(3):
            for s, (cost, audit, pairs) in list(best.items()):
                for role, t in move[s].items():
                    new = (cost + 3, audit + "I", (*pairs, "I" + role))
                    if role != "s" and (t not in best or new[:2] < best[t][:2]):
                        best[t] = new
        return best

    best = {0: (0, "", ())}
    for kind in kinds:
        after = {}
        for s, (cost, audit, pairs) in inserted(best).items():
            options = [("D", s, 4, "-")]
            if kind != "-":
                late = 3 if kind.isupper() else 0
                options += [("K", t, late, role) for role, t in move[s].items() if role == kind.lower()]
                options += [("R", t, 3 + late, role) for role, t in move[s].items() if role != "s"]
            for edit, t, more, role in options:
                new = (cost + more, audit + edit, (*pairs, edit + role))
                if t not in after or new[:2] < after[t][:2]:
                    after[t] = new
        best = after
    best = inserted(best)
    return min(best[s] for s in (0, 3) if s in best)


def test_meeting_costs_give_the_audit_least_of_the_cheapest_edits():
    for size in (1, 2, 3):
        for kinds in itertools.product("suaxSUAX-", repeat=size):
            steps, _ = solved("".join(kinds), 0, list(conversations.FINAL), True)
            assert "".join(steps) == "".join(cheapest(kinds)[2]), kinds
    for _ in range(2000):
        kinds = "".join(RNG.choices("suaxSUAX-", k=RNG.randint(4, 24)))
        steps, _ = solved(kinds, 0, list(conversations.FINAL), True)
        assert "".join(steps) == "".join(cheapest(kinds)[2]), kinds


def test_runs_put_together_are_the_whole():
    for _ in range(300):
        kinds = "".join(RNG.choices("suaxSUAX-", k=RNG.randint(2, 30)))
        cut = sorted(RNG.sample(range(1, len(kinds)), RNG.randint(1, min(4, len(kinds) - 1))))
        runs = [kinds[a:b] for a, b in zip([0, *cut], [*cut, len(kinds)], strict=True)]
        ends = conversations._ends_of([conversations.matrix(r) for r in runs], list(conversations.FINAL))
        leads = [[solve(r, s, e)[1] for s in range(4)] for r, e in zip(runs, ends, strict=True)]
        starts = conversations._starts_of(leads, 0)
        found = [solved(r, s, e, i == len(runs) - 1)[0] for i, (r, s, e) in enumerate(zip(runs, starts, ends, strict=True))]
        assert "".join("".join(f) for f in found) == "".join(cheapest(kinds)[2])


def expected_repair(rows):
    """Per conversation by brute force; rows (conv, turn, role, text)."""
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn is not None, turn or 0, " " if role is None else role, hashlib.sha256((" " if text is None else text).encode()).hexdigest(), " " if text is None else text))
    out = {}
    for conv, held in groups.items():
        held.sort()
        seen, faults, kinds = set(), Counter(), ""
        for _, _, role, _, text in held:
            initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
            fault = "blank" if not re.search(GAP, text) else "duplicate" if (role, text) in seen else "truncated" if not re.search(r"[.!?][\x20\x09-\x0D]*\Z", text) else ""
            seen.add((role, text))
            faults[fault] += 1
            kinds += "-" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        turns = [t for known, t, *_ in held if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        roles = [r[:1] for _, _, r, _, _ in held]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(roles))
        cost, audit, pairs = cheapest(kinds)
        at, lines = 0, []
        for edit, role in pairs:
            given = "user" if role == "u" else "assistant"
            if edit == "I":
                lines.append(f"{given}:")
                continue
            _, _, own, _, text = held[at]
            at += 1
            if edit != "D":
                lines.append(f"{own if edit == 'K' else given}:{text}")
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found_repair(repaired):
    hashes = {r.conv_id: r.repaired_sha256 for r in digests(repaired.rows).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, hashes.get(r.conv_id, empty)) for r in repaired.conversations.collect()}


CONV = "conv_id bigint, turn bigint, role string, text string"
TEXTS = ["Well.", "Well.", "So what?", "no end", "", " \t", "Ends!\n", "x" * 100_000 + ".", "é.", None]
ROLES = ["user", "assistant", "user", "assistant", "system", "tool", None, ""]


def conversation_rows():
    rows = [(c, RNG.choice([None, *range(6)]), RNG.choice(ROLES), RNG.choice(TEXTS)) for c in (1, 2, 3, 4, None) for _ in range(RNG.randint(3, 9))]
    rows += [(7, t, "user" if t % 2 else "assistant", f"Turn {t}." if t % 7 else f"Turn {t}") for t in range(60)]
    rows += [(8, 0, "user", "Same.")] * 20 + [(9, 5, "assistant", "Only an answer.")] + [(10, 3, "user", "")] * 2
    return rows


@pytest.mark.parametrize("bits", [(12, 12), (1, 1), (2, 12)])
def test_conversations_against_brute_force(spark, bits):
    rows = conversation_rows()
    table = spark.createDataFrame(rows, CONV).select("*", *[F.lit("x").alias(c) for c in ("conv", "block", "position", "kinds", "summary", "id", "spread")])
    found = found_repair(repair(table.repartition(5), block_bits=bits[0], fan_bits=bits[1]))
    assert found == expected_repair(rows)


def test_string_ids_and_empty_conversations(spark):
    rows = spark.createDataFrame([("b", 1, "user", "Hi."), ("a", 1, "user", "Hi."), ("a", 2, "assistant", "Yes.")], CONV.replace("conv_id bigint", "conv_id string"))
    found = found_repair(repair(rows))
    assert found["a"][5:7] == (0, "KK") and found["b"][5:7] == (3, "KI")
    assert found_repair(repair(rows.limit(0))) == {}


def test_damage_is_that_of_the_contract(spark):
    import zlib

    given = [(c, t, "assistant", "A b. c!") for c in range(20) for t in (None, 0, 1, 2)] + [(None, None, None, None)]
    want = Counter()
    for c, t, role, text in given:
        role, text = role or " ", text or " "
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fault, text)
        want[(c, t, "user" if fault == 4 else role, text)] += {0: 0, 3: 2}.get(fault, 1)
    assert Counter(tuple(r) for r in damaged(spark.createDataFrame(given, CONV)).collect()) == +want


# Filter interaction audit


def test_tries_hold_the_least_id_of_each_text():
    texts = [b"", b"a", b"ab", b"abc" * 50, b"abc" * 50 + b"d", b"abd", b"b", "é".encode(), b"abc" * 49]
    rows = [(RNG.choice([None, *range(30)]), RNG.choice(texts)) for _ in range(300)]
    trie, want = Trie(), {}
    for i, (key, text) in enumerate(rows):
        trie.insert(text, key, i)
        want.setdefault(text, []).append((key, i))
    found = {rows[held[0][1]][1]: (least, held) for least, held in trie.terminals()}
    assert found == {t: (min((k for k, _ in held if k is not None), default=None), held) for t, held in want.items()}


def fails(text):
    words = re.findall(GAP, text)
    return "".join(name for name, bad in zip("ABCD", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search("[#$%&*|]", text))), strict=True) if bad)


LONG = " ".join(f"w{i}" for i in range(220))
FILTERED = [
    (1, LONG, "a"), (2, LONG, "a"), (2, LONG, "b"), (3, LONG, None), (None, LONG, "b"), (None, LONG, "b"), (None, "only here", "a"), (None, "only here", "a"),
    (4, "", "a"), (5, None, "c"), (6, " ", "a"), (7, LONG + "#", "a"), (8, "w " * 300, "a"), (9, "W " * 300, "b"), (10, LONG.upper(), "b"), (11, LONG.upper(), "c"),
    (12, "é É ﬀ" * 90_000, "a"), (13, "é É ﬀ" * 90_000, "d"), (14, LONG + " tail", "a"), (15, LONG + " tail", "b"), (0, "short", "d"), (16, "short", "d"),
]
DOCS = "doc_id bigint, text string, source string"


@pytest.mark.parametrize("small", [False, True])
def test_filters_against_brute_force(spark, monkeypatch, small):
    if small:  # tries of a few texts, prefixes split at once
        for name, value in (("TRIE_BYTES", 3_000), ("PART_BYTES", 200), ("DEPTHS", (2, 4))):
            monkeypatch.setattr(filters, name, value)
    docs = spark.createDataFrame(FILTERED, DOCS).select("*", *[F.lit("x").alias(c) for c in ("id", "part", "body", "mask", "n", "members", "key")])
    first = {}
    for i, text, _ in FILTERED:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    want = Counter()
    for i, text, part in FILTERED:
        text = text or ""
        copy = text in first and (i is None or i > first[text])
        want[(i, part or "", fails(text) + ("E" if copy else ""))] += 1
    masks = filter_masks(docs.repartition(4), F.col("source"))
    found = Counter()
    for r in masks.collect():
        found[(r.id, r.part, "".join(f for b, f in enumerate("ABCDE") if r.mask >> b & 1))] += r.n
    assert found == want
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (7, 1, None), (9, 0, 1), (15, None, 1), (None, 1, 1), (99, 1, 1)]
    good, bad = {i for i, q, _ in labels if q == 1 and i}, {i for i, _, t in labels if t == 1 and i}
    rows = {(r.part, r.filter_order, r.step): r for r in interactions(masks, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()}
    parts = {p for _, p, _ in want}
    assert len(rows) == len(parts) * 600
    shapley = Counter()
    for part in parts:
        own = [(i, f, n) for (i, p, f), n in want.items() if p == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                r = rows[(part, "".join(order), step)]
                removed = [x for x in left if name in x[1]]
                left = [x for x in left if name not in x[1]]
                count = lambda held: sum(n for _, _, n in held)
                assert r.kept == count(left) and r.removed == count(removed)
                assert r.redundant == count([x for x in own if name in x[1] and set(order[: step - 1]) & set(x[1])])
                assert r.unique_fails == count([x for x in own if x[1] == name])
                assert r.good_lost == count([x for x in removed if x[0] in good]) and r.toxic_lost == count([x for x in removed if x[0] in bad])
                shapley[(part, name)] += count(removed)
    for (part, order, step), r in rows.items():
        assert r.shapley == shapley[(part, order[step - 1])]


def test_filters_of_empty_tables_and_string_ids(spark):
    labels = spark.createDataFrame([], "doc_id string, quality int, toxic int")
    docs = spark.createDataFrame([("b", "same", "x"), ("a", "same", "x")], DOCS.replace("doc_id bigint", "doc_id string"))
    assert {(r.id, r.mask >> 4) for r in filter_masks(docs, F.col("source")).collect()} == {("a", 0), ("b", 1)}
    assert interactions(filter_masks(docs.limit(0), F.col("source")), labels).count() == 0


# Toxicity


def labelled(n):
    """Ordinary words of syllables; toxic documents hold a few of some marked words too."""
    rng = random.Random(3)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    usual = ["".join(rng.choices(syllables, k=rng.randint(2, 4))) for _ in range(600)]
    marked = ["zwixo", "vyqquam", "hexxoly", "jyzzabel", "quuxter"]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 6 == 0
        words = rng.choices(usual, k=rng.randint(30, 200))
        for _ in range(rng.randint(3, 6) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(marked))
        rows.append((i, " ".join(words), "src"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_of_held_out_documents(spark):
    rows, labels = labelled(900)
    found = toxicity.toxicity(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    held = [r for r in found if r.held_out]
    assert len(held) > 100
    hit = [r.predicted for r in held if r.doc_id % 6 == 0]
    false = [r.predicted for r in held if r.doc_id % 6]
    assert sum(hit) >= 0.9 * len(hit) and sum(false) <= 0.02 * len(false)


def test_held_out_labels_teach_nothing(spark):
    """Turning the held-out labels around changes no score."""
    rows, labels = labelled(240)
    docs = spark.createDataFrame(rows, DOCS)
    schema = "doc_id bigint, quality int, toxic int"
    held = {r.doc_id for r in docs.filter(toxicity.held_out(F.col("doc_id"))).collect()}
    turned = [(i, q, 1 - t if i in held else t) for i, q, t in labels]
    scores = lambda given: {r.doc_id: r.score for r in toxicity.toxicity(docs, spark.createDataFrame(given, schema)).collect()}
    assert scores(labels) == scores(turned)


def test_toxicity_of_awkward_rows(spark):
    rows, labels = labelled(60)
    odd = [(None, "null id zwixo", "s"), (None, None, None), (1000, None, "s"), (1001, "", "s"), (1001, "", "s"), (1002, "x" * 300_000, "s"), (1003, "word " * 50_000, "s"), (1004, "퟿ ☃ 123", "s"), (0, "another text of a taught id", "s")]
    docs = spark.createDataFrame(rows + odd, DOCS).select("*", *[F.lit("x").alias(c) for c in ("id", "toxic", "group", "half", "order", "score", "held_out")])
    marks = [*labels, (0, 0, 0), (1, None, None), (None, 1, 1)]
    table = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    found = toxicity.toxicity(docs, table).collect()
    assert Counter(r.doc_id for r in found) == Counter(i for i, _, _ in rows + odd)
    assert len({r.score for r in found if r.doc_id in (1000, 1001)}) == 1 and not any(r.held_out for r in found if r.doc_id is None)
    assert {r.score for r in toxicity.toxicity(docs, table.limit(0)).collect()} == {0.0}
    assert {r.score for r in toxicity.toxicity(docs, table.filter("toxic = 1")).collect()} == {1.0}
    assert toxicity.toxicity(docs.limit(0), table).count() == 0
