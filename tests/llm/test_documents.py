"""Operators over documents against brute force, and on awkward rows."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from sitelens.llm.exact import exact_dedup
from sitelens.llm.language import language_id
from sitelens.llm.lines import dedup_lines
from sitelens.llm.minhash import near_duplicates
from sitelens.llm.mixing import mix
from sitelens.llm.pieces import decode, encode
from sitelens.llm.queries import MIX_WEIGHTS, mix_levels, vocabulary
from sitelens.llm.substring import remove_repeats
from sitelens.llm.tokencount import count_tokens

BPE, PIECES = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
RNG = random.Random(5)
WORDS = [f"w{i}x" for i in range(400)]


def words(n):
    return RNG.choices(WORDS, k=n)


def corpus():
    """Copies, near copies of one text, shared passages, repeated lines, short and empty texts."""
    base, passage = words(160), words(60)
    texts = [" ".join(base)] * 4 + ["  ".join(base).upper()]
    for share in (0.02, 0.03, 0.05, 0.08) * 6:
        texts.append(" ".join(w if RNG.random() > share else RNG.choice(WORDS) for w in base))
    texts += [" ".join(words(30) + passage + words(30)) for _ in range(4)]
    line = " ".join(words(12))
    texts += ["\n".join([" ".join(words(15)), line, "", " ".join(words(9))]) for _ in range(5)]
    texts += [line.replace("w1", "v1", 1), "one two", "one two", "One  two", "", "   ", "a", "\n\n", "x " * 80]
    texts += [" ".join(words(RNG.randint(1, 120))) for _ in range(25)]
    return list(enumerate(texts))


CORPUS = corpus()
ODD = [
    (None, "null id here one two three four five six"), (None, None), (7, None), (8, ""), (9, "same text " * 30), (9, "same text " * 30),
    (10, "é" * 50_000), (11, "word " * 30_000), (12, "tab\tand\x0bvt\x0c\r\n end"), (13, "\U0001f600 🇦 ‌ ｆｕｌｌ"), (14, "<|endoftext|> x"), (15, "▁"),
]
#: Columns that clash with names the operators use inside.
EXTRA = ["id", "n", "body", "doc", "digest", "key", "rep", "lines", "words", "component", "bucket", "score", "holds", "_body", "label"]
SCHEMA = "doc_id bigint, text string, lang string, source string"


def table(spark, rows, extra=False):
    out = spark.createDataFrame([(i, t, "en" if (i or 0) % 3 else None, f"src{(i or 0) % 3}") for i, t in rows], SCHEMA)
    return out.select("*", *[F.lit("x").alias(c) for c in EXTRA]) if extra else out


def run_all(docs):
    mixed = lambda d: mix(d, mix_levels(), MIX_WEIGHTS, F.floor(F.col("total") / 2), epochs=2)
    operators = {
        "lines": dedup_lines, "minhash": near_duplicates, "substring": remove_repeats, "tokens": lambda d: count_tokens(d, BPE),
        "pieces": lambda d: encode(d, PIECES), "language": language_id, "exact": exact_dedup, "mixing": mixed,
    }
    return {name: f(docs).collect() for name, f in operators.items()}


def test_awkward_rows_keep_their_number(spark):
    found = run_all(table(spark, ODD, extra=True))
    for name, rows in found.items():
        assert len(rows) == len(ODD), name
    for r in found["language"]:
        assert 0 <= r.score <= 1
    assert {r.lang_pred for r in found["language"] if r.doc_id in (7, 8)} == {"und"}
    empties = [r for r in found["exact"] if r.group_size == 3]
    assert len(empties) == 3 and {r.keep_id for r in empties} == {7}
    assert sum(r.kept for r in found["exact"] if r.doc_id == 9) == 1
    assert all(r.component_id is None and not r.kept for r in found["minhash"] if r.doc_id is None)
    assert [r.n_tokens for r in found["tokens"] if r.doc_id == 14] == [2]
    assert all(len(r.ids) == 0 for r in found["pieces"] if r.doc_id in (7, 8))


def test_empty_tables(spark):
    for name, rows in run_all(table(spark, [])).items():
        assert rows == [], name


def test_exact(spark):
    rows = exact_dedup(table(spark, CORPUS), files_per_trigger=1).collect()
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t) for i, t in CORPUS}
    groups = {}
    for i, t in norm.items():
        groups.setdefault(t, []).append(i)
    for r in rows:
        own = groups[norm[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept) == (min(own), len(own), r.doc_id == min(own))
        assert r.text_sha256 == hashlib.sha256(norm[r.doc_id].encode()).hexdigest()


def test_exact_tells_texts_of_one_digest_apart(spark):
    weak = exact_dedup(table(spark, CORPUS), digest=lambda c: F.substring(F.sha1(c), 1, 1)).collect()
    key = lambda rows: sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows)
    assert key(weak) == key(exact_dedup(table(spark, CORPUS)).collect())


def test_exact_state_carries_over_batches(spark):
    docs = table(spark, CORPUS).repartition(6)
    key = lambda rows: sorted((r.doc_id, r.keep_id, r.group_size) for r in rows)
    assert key(exact_dedup(docs, files_per_trigger=1).collect()) == key(exact_dedup(docs).collect())


@pytest.mark.parametrize("weak", [False, True])
def test_exact_state_outlives_a_call(spark, tmp_path, weak):
    """Three arrivals with one state: each call's groups are those of all rows so far, and locators find their texts."""
    from sitelens.llm.exact import located, sha256

    parts = [CORPUS[30:], CORPUS[:20], CORPUS[20:30] + CORPUS[:3]]
    digest = (lambda c: F.substring(F.sha1(c), 1, 1)) if weak else sha256
    seen = []
    state = f"file://{tmp_path}/state"
    for part in parts:
        seen += part
        norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t)) for i, t in seen]
        for r in exact_dedup(table(spark, part), digest=digest, state=state).collect():
            own = [i for i, t in norm if t == re.sub(r"[\x20\x09-\x0D]+", " ", dict(part)[r.doc_id])]
            assert (r.keep_id, r.group_size) == (min(own), len(own))
    every = spark.read.parquet(f"{state}/arrivals")
    found = located(spark, state, every.select("batch", "locator", "sha"))
    assert found.filter(F.sha2("body", 256) != F.col("sha")).isEmpty() and found.count() == len(seen)


def shingles(text):
    own = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
    return frozenset([b" ".join(own)] if 0 < len(own) < 5 else [b" ".join(own[i : i + 5]) for i in range(len(own) - 4)])


def test_minhash_against_all_pairs(spark):
    sets = {i: shingles(t) for i, t in CORPUS}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    for r in near_duplicates(table(spark, CORPUS)).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root(r.doc_id), root(r.doc_id) == r.doc_id)


def test_one_id_with_two_texts_is_two_documents(spark):
    a, b, c = (" ".join(words(60)) for _ in range(3))
    rows = [(5, a), (5, b), (5, b), (7, b + " z"), (8, c), (None, b), (None, None)]
    found = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in near_duplicates(table(spark, rows)).collect())
    assert found == [(0, 0, 0, False), (0, 56, 0, False), (5, 56, 5, True), (5, 56, 5, True), (5, 56, 5, True), (7, 57, 5, False), (8, 56, 8, True)]
    removed = sorted((r.doc_id or 0, r.n_removed) for r in remove_repeats(table(spark, rows)).collect())
    assert removed == [(0, 0), (0, 60), (5, 0), (5, 60), (5, 60), (7, 60), (8, 0)]
    lines = sorted((r.doc_id or 0, r.n_removed) for r in dedup_lines(table(spark, rows)).collect())
    assert lines == [(0, 0), (0, 0), (5, 0), (5, 0), (5, 0), (7, 1), (8, 0)]


def test_minhash_joins_chains_across_components(spark, monkeypatch):
    import sitelens.llm.minhash as m

    monkeypatch.setattr(m, "BLOCK", 3)
    test_minhash_against_all_pairs(spark)


def test_minhash_sends_sets_only_where_texts_look_alike(spark, monkeypatch):
    """Texts that share a third of their shingles meet in buckets, but none of their sets needs to travel."""
    import sitelens.llm.minhash as m

    passage, seen, save = " ".join(words(100)), {}, m.Scratch.save

    def counted(self, df, name):
        out = save(self, df, name)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(m.Scratch, "save", counted)
    rows = [(i, f"{passage} {' '.join(words(90))}") for i in range(60)]
    assert all(r.component_id == r.doc_id and r.kept for r in near_duplicates(table(spark, rows)).collect())
    assert seen["homes"] > 40
    assert seen["full"] == 0


def test_minhash_shuffles_only_texts_with_a_partner(spark):
    """Texts that nothing is like stay where they lie, also where their keys are too many to be broadcast."""
    rng = random.Random(8)
    rows = [(i, " ".join(f"{rng.getrandbits(128):x}" for _ in range(600))) for i in range(300)]
    rows += [(i + 1000, t + " more") for i, t in rows[:3]]
    docs = table(spark, rows)
    stages = spark.sparkContext._jsc.sc().statusStore()

    def written():
        found = stages.executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    before, least = written(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = {r.doc_id: (r.component_id, r.kept) for r in near_duplicates(docs).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert kept == {i: (i % 1000, i < 1000) for i, _ in rows}
    time.sleep(1)  # what tasks report is added up behind their end
    assert written() - before < 0.3 * sum(len(t) for _, t in rows)


def test_rows_among_keys(spark):
    from sitelens.llm.bits import among

    rows = spark.range(20_000).withColumn("body", F.lit("x")).union(spark.createDataFrame([(None, "y"), (-5, "z")], "id bigint, body string"))
    keys = spark.range(0, 20_000, 10).union(spark.createDataFrame([(-5,)], "id bigint"))
    found = among(rows, "id", keys.union(keys))
    assert keys.join(found, "id", "left_anti").isEmpty() and found.filter("id = -5 and body = 'z'").count() == 1
    assert found.count() < 2_001 + 18_000 / 30
    assert among(rows, "id", keys.limit(0)).count() == 0


def test_marks_agree_where_registers_do():
    import numpy as np

    import sitelens.llm.minhash as m

    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 1 << 16, (2, 500, m.BUCKETS)).astype(np.uint16)
    b = np.where(rng.random(a.shape) < 0.75, a, b)
    same, found = (a == b).sum(axis=1), m.agreeing(m.marks(a), m.marks(b))
    assert (found >= same).all() and (found >= m.MARKED).all()
    assert abs((found - same).mean() / (m.BUCKETS - same).mean() - 0.25) < 0.02


def test_substring_against_all_windows(spark):
    words_of = {i: re.findall(r"[^\x20\x09-\x0D]+", t) for i, t in CORPUS}
    seen = {}
    for i, w in words_of.items():
        for p in range(len(w) - 34):
            seen.setdefault(tuple(w[p : p + 35]), []).append((i, p))
    gone = {(i, p + k) for places in seen.values() if len(places) > 1 for i, p in places for k in range(35)}
    for r in remove_repeats(table(spark, CORPUS)).collect():
        kept = [w for p, w in enumerate(words_of[r.doc_id]) if (r.doc_id, p) not in gone]
        assert (r.n_words, r.n_removed, r.kept_text) == (len(words_of[r.doc_id]), len(words_of[r.doc_id]) - len(kept), " ".join(kept))


def test_substring_hot_minimisers_go_window_by_window(spark, monkeypatch):
    import sitelens.llm.substring as s

    monkeypatch.setattr(s, "HOT", 2)
    test_substring_against_all_windows(spark)


def test_lines_against_all_pairs(spark):
    lines = [(i, n, x, frozenset(x.encode().lower().split())) for i, t in CORPUS for n, x in enumerate(t.split("\n"))]
    gone = set()
    for k, (i, n, _, s) in enumerate(lines):
        if s and any(o and 100 * len(s & o) >= 75 * len(s | o) for _, _, _, o in lines[:k]):
            gone.add((i, n))
    for r in dedup_lines(table(spark, CORPUS)).collect():
        own = [(n, x) for i, n, x, _ in lines if i == r.doc_id]
        kept = [x for n, x in own if (r.doc_id, n) not in gone]
        assert (r.n_lines, r.n_removed, r.kept_text) == (len(own), len(own) - len(kept), "\n".join(kept))


def test_lines_with_small_limits_give_the_same(spark, monkeypatch):
    """Lists shuffled, every word split over pairs of blocks, few pairs and lines at a time."""
    import sitelens.llm.lines as m

    for name, value in (("BROADCAST_BYTES", -1), ("BROADCAST_ROWS", -1), ("POSTINGS", 3), ("LINES", 2), ("PAIRS", 7), ("PACKED", 50)):
        monkeypatch.setattr(m, name, value)
    test_lines_against_all_pairs(spark)


def test_lines_that_meet_in_blocks_are_hashed_together(monkeypatch):
    import numpy as np
    import pyarrow as pa

    import sitelens.llm.lines as m
    import sitelens.llm.words as w

    calls, split = [], w.split
    for module in (m, w):
        monkeypatch.setattr(module, "split", lambda *a, **b: calls.append(1) or split(*a, **b))
    base, rng = [f"B{i}" for i in range(12)], random.Random(3)
    lines = [" ".join(x if rng.random() > 0.15 else f"n{rng.randrange(40)}" for x in base) for _ in range(120)] + [" B0\tb0 B1 ", "x" * 200]
    keys = [i // 61 for i in range(len(lines))]
    columns = {"key": keys, "p": [0] * len(lines), "q": [0] * len(lines), "side": np.zeros(len(lines), np.int32), "doc": range(len(lines)), "line": [0] * len(lines), "open": [True] * len(lines), "words": [x.encode() for x in lines]}
    rows = pa.table({k: pa.array(v) for k, v in columns.items()})
    found = sorted(x for batch in m._settle(iter(rows.to_batches(max_chunksize=50))) for x in batch.column(0).to_pylist())
    assert found == [i for i in range(len(lines)) if any(keys[i] == keys[j] and m._alike(rows["words"][i].as_py(), rows["words"][j].as_py()) for j in range(i))] != []
    assert len(calls) <= 5


def test_lines_that_only_match_a_partner_that_differs_more(spark):
    """Families in which the closest earlier line is just below the threshold, and ties of it."""
    rng = random.Random(8)
    base = [f"q{i}" for i in range(24)]
    lines = []
    for k in range(60):
        own = base[:]
        for i in rng.sample(range(24), rng.choice((2, 3, 3, 4))):
            own[i] = f"z{rng.randrange(40)}"
        lines.append(" ".join(own))
    texts = [(k, x) for k, x in enumerate(lines)]
    sets = [frozenset(x.encode().split()) for x in lines]
    gone = {k for k in range(60) if any(100 * len(sets[k] & sets[j]) >= 75 * len(sets[k] | sets[j]) for j in range(k))}
    found = {r.doc_id for r in dedup_lines(table(spark, texts)).collect() if r.n_removed}
    assert found == gone and 5 < len(gone) < 59


def test_token_counts_match_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    texts = CORPUS + [(1000 + i, t) for i, t in enumerate(["can't  WON'T", "²٣ ９x", "a<|endoftext|>b<|endoftext|>", "naïve — 日本語 \x1c\x85　y", "'s 're"])]
    for r in count_tokens(table(spark, texts), BPE, limit=50).collect():
        text = dict(texts)[r.doc_id]
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 50)


def test_pieces_match_the_library_and_come_back(spark):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(PIECES, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1  # the same pieces, read as a lattice
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    texts = list(enumerate(["hello world", "a", "The quick brown fox, jumps.", "internationalization of things", "  two  spaces ", "naïve"]))
    rows = encode(table(spark, texts), PIECES, n=5)
    for r in rows.collect():
        paths = []
        for p in r.n_best:
            ids = list(r.ids)
            for e in sorted(p.edits, key=lambda e: -e.start):
                ids[e.start : e.stop] = e.ids
            paths.append(tuple(ids))
        expected = library.nbest_encode(dict(texts)[r.doc_id], nbest_size=5, out_type=int)
        if len(set(p.score for p in r.n_best)) == len(r.n_best) == len(expected):
            assert sorted(paths) == sorted(map(tuple, expected))
        assert paths[0] == tuple(expected[0]) and [p.score for p in r.n_best] == sorted((p.score for p in r.n_best), reverse=True)
    every = CORPUS + [(1000, "🇦 \x00 \x85 日本\r\n\t")]
    back = {r.doc_id: r.decoded for r in decode(encode(table(spark, every), PIECES), PIECES).collect()}
    assert back == dict(every)


def test_pieces_against_every_segmentation():
    from sitelens.llm.pieces import Model

    model = Model(PIECES)

    def every(part):
        if not part:
            yield 0.0, []
        for j, piece, score in model.edges_from(part, 0) if part else []:
            for s, rest in every(part[j:]):
                yield score + s, [piece, *rest]

    parts = ["▁there", "▁aaaa", "ations", "▁", "q", "▁日本"]
    score, loss, count, ids = model.lattice(parts)
    ends = count.cumsum()
    for k, part in enumerate(parts):
        expected = sorted((s for s, _ in every(part)), reverse=True)
        found = model.n_best(part, 6)
        assert [s for s, _ in found] == expected[:6]
        assert len({tuple(ids) for _, ids in found}) == len(found)
        assert (score[k], loss[k]) == (expected[0], expected[0] - expected[1] if len(expected) > 1 else float("inf"))
        own = ids[ends[k] - count[k] : ends[k]].tolist()
        assert own == model.best(part)[2].tolist() and (own in [i for _, i in found])


def test_pieces_of_whole_documents(spark, monkeypatch):
    """Whole documents: merges as the library does, n best as every choice of changes gives, small memories change nothing."""
    import sentencepiece

    import sitelens.llm.pieces as m

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("doc_id < 80")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = encode(docs, PIECES, n=4, merged=True).collect()
    for r in rows:
        assert r.merged_ids == library.encode(texts[r.doc_id])
    segmenter = m.Segmenter(m.Model(PIECES))
    monkeypatch.setattr(m, "WORD_BYTES", 0)
    monkeypatch.setattr(m, "OTHER_BYTES", 0)
    monkeypatch.setattr(m, "CELLS", 50)
    monkeypatch.setattr(m, "LONG", 6)
    for r in rows:
        (ids, _), paths, _ = segmenter.encode([texts[r.doc_id]], 4)
        assert ids.tolist() == r.ids and [p[0] for p in paths[0]] == [p.score for p in r.n_best]
    for r in rows:
        score = {i: s for i, s in segmenter.model.pieces.values()}
        seen = set()
        for p in r.n_best:
            own = list(r.ids)
            for e in sorted(p.edits, key=lambda e: -e.start):
                own[e.start : e.stop] = e.ids
            seen.add(tuple(own))
            if all(i in score for i in own):
                assert p.score == sum(score[i] for i in own)
            back = segmenter.model.decode(m.np.array(own, dtype="int64"), m.np.array([len(own)]))
            assert back == [texts[r.doc_id]]
        assert len(seen) == len(r.n_best)


def test_language_is_right_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert found and sum(r.lang == r.lang_pred for r in found) >= 0.97 * len(found)


def brute_language(rows, max_words=None, max_grams=None):
    """Word-first backoff in plain Python: (id, text, lang, held out) -> {id: (language, score)}."""
    import math
    from collections import Counter

    counts = {}
    for _, text, lang, out in rows:
        if lang is not None and not out and text:
            counts.setdefault(lang, Counter()).update(re.findall(r"[^\W\d_]+", text.lower()))
    langs = sorted(counts)
    kinds = {0: {l: c for l, c in counts.items()}}
    for size in (4, 3, 2, 1):
        kinds[size] = {l: Counter() for l in langs}
        for l, c in counts.items():
            for w, n in c.items():
                for i in range(len(w) + 3 - size):
                    kinds[size][l][f"<{w}>"[i : i + size]] += n
    tables = {}
    for kind, by_lang in kinds.items():
        keys = set().union(*by_lang.values()) if langs else set()
        total = {l: sum(c.values()) + 0.5 * len(keys) for l, c in by_lang.items()}
        tables[kind] = {k: [math.log((by_lang[l][k] + 0.5) / total[l]) for l in langs] for k in keys}
    out = {}
    for i, text, _, _ in rows:
        sums, spoken = [0.0] * len(langs), 0
        for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
            if not any(map(str.isalpha, w)):
                continue
            spoken += 1
            value = tables[0].get(w)
            if value is None:
                value = [0.0] * len(langs)
                for size in (4, 3, 2, 1):
                    known = [v for k in range(len(w) + 3 - size) if (v := tables[size].get(f"<{w}>"[k : k + size]))]
                    if known:
                        value = [0.5 * sum(v[j] for v in known) / len(known) for j in range(len(langs))]
                        break
            sums = [a + b for a, b in zip(sums, value)]
        if not spoken or not langs:
            out[i] = ("und", 0.0)
            continue
        top = max(sums)
        share = [math.exp((s - top) * min(1.0, 10.0 / spoken)) for s in sums]
        out[i] = (langs[sums.index(top)], max(share) / sum(share))
    return out


def test_language_against_brute_force(spark):
    import zlib

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = [(9_001, "supercalifragilistic" * 40, "en", "s"), (9_002, None, "de", "s"), (9_003, "1234 ?!", "en", "s"), (9_004, "éé ß zz", None, "s")]
    docs = docs.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(odd, SCHEMA))
    rows = [(r.doc_id, r.text, r.lang, zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in docs.collect()]
    expected = brute_language(rows)
    from sitelens.llm.language import fit, held_out, identify

    whole = fit(docs.filter(~held_out(F.col("doc_id"))), max_words=10**7, max_grams=10**7)
    for r in identify(docs, whole).collect():
        lang, score = expected[r.doc_id]
        assert r.lang_pred == lang and abs(r.score - score) < 1e-6
    # What the production limits cut off changes no language here.
    limited = {r.doc_id: r.lang_pred for r in language_id(docs).collect()}
    assert sum(limited[i] == lang for i, (lang, _) in expected.items()) >= 0.99 * len(expected)


def test_language_limits_leave_no_language_without_keys(spark):
    """Equal counts beyond the limit: an even part is kept, for each language its own."""
    from sitelens.llm.language import fit

    rows = [(i, f"w{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}{chr(97 + i // 676)}", "en" if i % 20 else "xx", "s") for i in range(1040)]
    model = fit(spark.createDataFrame(rows, SCHEMA), max_words=400, max_grams=100)
    assert 100 < len(model.words) <= 400 and all(grams for _, grams in model.grams)
    rare = {w for i, w, lang, _ in rows if lang == "xx"}
    assert len(rare & set(model.words)) == len(rare)


def test_language_without_labels(spark):
    rows = language_id(table(spark, [(3, "some words")]).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert [(r.lang_pred, r.score) for r in rows] == [("und", 0.0)]


@pytest.mark.parametrize("share,epochs", [(0.3, 1), (0.9, 1), (1.6, 2), (9, 2)])
def test_mixing_keeps_its_budgets(spark, share, epochs):
    rows = mix(table(spark, CORPUS), mix_levels(), {("family0",): 5}, F.floor(F.col("total") * share), epochs=epochs, seed=3).collect()
    total = sum(r.n_tokens for r in rows)
    budgets = {(r.domain, r.lang, r.source): r.leaf_budget for r in rows}
    assert sum(budgets.values()) <= min(total * share, total * epochs)
    assert sum(budgets.values()) >= min(total * share, total * epochs) - 3 * len(budgets) - 1
    for leaf, budget in budgets.items():
        own = [r for r in rows if (r.domain, r.lang, r.source) == leaf]
        taken = sum(r.n_tokens * r.copies for r in own)
        assert taken <= budget and all(0 <= r.copies <= epochs for r in own)
        longest = max((r.n_tokens for r in own), default=0)
        assert taken + longest >= min(budget, sum(r.n_tokens for r in own) * epochs)


def thue_morse(n, swapped=False):
    """Two such words have equal polynomials modulo 2^64 for every odd base."""
    letters = "ba" if swapped else "ab"
    return "".join(letters[i.bit_count() % 2] for i in range(n))


@pytest.mark.parametrize("size", [1024, 4096])
def test_words_made_to_collide_stay_apart(spark, size):
    texts = [thue_morse(size), thue_morse(size, swapped=True)]
    docs = table(spark, list(enumerate(texts)))
    assert all(r.component_id == r.doc_id and r.kept for r in near_duplicates(docs).collect())
    lines = table(spark, [(0, "\n".join(texts)), (1, "\n".join(f"{t} tail of five more words" for t in texts))])
    assert {r.n_removed for r in dedup_lines(lines).collect()} == {0}


def test_string_ids(spark):
    rows = [(f"id-{i}", t) for i, t in CORPUS[:40]]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    plain = table(spark, CORPUS[:40])
    for f, value in ((dedup_lines, "n_removed"), (near_duplicates, "kept"), (remove_repeats, "n_removed")):
        found = {r.doc_id: r[value] for r in f(docs).collect()}
        want = {f"id-{r.doc_id}": r[value] for r in f(plain).collect()}
        assert set(found) == set(want)
        if f is remove_repeats:
            assert found == want
        else:  # of a group the least id stays, and strings are ordered otherwise
            assert sum(map(int, found.values())) == sum(map(int, want.values()))


def test_exact_state_after_a_failed_call(spark, tmp_path, monkeypatch):
    """A call that fails in any place counts for nothing; the one after it counts each row once."""
    from sitelens.llm import exact

    state = f"file://{tmp_path}/state"
    first, second = CORPUS[:20], CORPUS[10:40]
    for broken in ("_state_of", "partitions"):
        own = f"{state}-{broken}"
        exact_dedup(table(spark, first), state=own).collect()
        real = exact._state_of

        def fails(*given, real=real, broken=broken):
            if broken == "partitions":
                real(*given)  # the state has the rows already
            raise OSError("lost")

        monkeypatch.setattr(exact, "_state_of", fails)
        with pytest.raises(OSError, match="lost"):
            exact_dedup(table(spark, second), state=own)
        monkeypatch.setattr(exact, "_state_of", real)
        found = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup(table(spark, second), state=own).collect()}
        norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
        for i, t in second:
            same = [j for j, u in first + second if norm(u) == norm(t)]
            assert found[i] == (min(same), len(same)), (broken, i)
