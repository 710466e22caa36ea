"""Clusters of similar texts against brute force over all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelens.operators import duplicates
from sitelens.operators.duplicates import duplicate_clusters, find_duplicates

RNG = random.Random(9)


def triples(text):
    w = text.split()
    return frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) > 2 else frozenset(w)


def similarity(a, b):
    union = len(a | b)
    part, rest = divmod(10_000 * len(a & b), union)
    return (part + (2 * rest > union or (2 * rest == union and part % 2 == 1))) / 10_000


def brute_force(docs, threshold):
    """Cluster: (ids, lowest similarity over all pairs)."""
    sets = {i: triples(t or "") for i, t in docs}
    same = {i: (t or "").split() for i, t in docs}
    alike = lambda i, j: 1.0 if same[i] == same[j] else similarity(sets[i], sets[j]) if sets[i] and sets[j] else 0.0
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and root[i] != root[j] and alike(i, j) >= threshold:
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    clusters = {}
    for i, r in root.items():
        clusters.setdefault(r, []).append(i)
    return {c: (sorted(m), min(alike(i, j) for i in m for j in m if i < j)) for c, m in clusters.items() if len(m) > 1}


def varied(base, share, vocabulary):
    return " ".join(w if RNG.random() > share else RNG.choice(vocabulary) for w in base)


def corpus():
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for size, share in ((25, 0.02), (40, 0.04), (12, 0.06)):
        base = RNG.choices(vocabulary, k=120)
        texts += [varied(base, share * RNG.random(), vocabulary) for _ in range(size)]
    chain = RNG.choices(vocabulary, k=100)
    for _ in range(15):  # each is like the one before it only
        chain = chain[4:] + RNG.choices(vocabulary, k=4)
        texts.append(" ".join(chain))
    texts += [" ".join(RNG.choices(vocabulary, k=RNG.randint(1, 60))) for _ in range(40)]
    texts += ["", "  ", None, "one", "one two", "one two", "one two three", "w1 " * 30, "w1 " * 31]
    RNG.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("block", "threshold"), [(500, 0.85), (7, 0.85), (4, 0.6)])
def test_clusters_against_brute_force(spark, monkeypatch, block, threshold):
    monkeypatch.setattr(duplicates, "BLOCK", block)  # small blocks: shells, bounds and block pairs are all met
    docs = corpus()
    found = duplicate_clusters(spark.createDataFrame(docs, "doc_id int, text string").repartition(6), threshold).collect()
    assert {r.cluster: (r.ids, float(r.similarity)) for r in found} == brute_force(docs, threshold)
    assert all(r.exact == (r.similarity == 1) for r in found)


def test_a_large_family_lists_no_pairs(spark, monkeypatch):
    """Rows behind every step grow with the family, not with its square."""
    monkeypatch.setattr(duplicates, "BLOCK", 60)
    vocabulary = [f"w{i}" for i in range(2_000)]
    base = RNG.choices(vocabulary, k=200)
    docs = []
    for i in range(400):
        words = list(base)
        for at in RNG.sample(range(200), i % 4):
            words[at] = RNG.choice(vocabulary)
        docs.append((i, " ".join([*words, f"tail{i}"])))
    written = {}
    real = duplicates.Scratch.save

    def counted(self, df, name):
        out = real(self, df, name)
        written[name] = max(written.get(name, 0), out.count())
        return out

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(duplicates.Scratch, "save", counted)
        found = find_duplicates(spark.createDataFrame(docs, "doc_id int, text string"))
        clusters = found.clusters.collect()
    assert [(r.cluster, r.size) for r in clusters] == [(0, 400)] and found.members.count() == 400
    sets = {triples(t) for _, t in docs}
    assert float(clusters[0].similarity) == min(similarity(a, b) for a in sets for b in sets)
    assert written["links"] < 400 and written["more"] < 400 and written["members"] < 60 * 400


def test_string_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([("b", "x y z"), ("a", "x  y z"), ("c", None)], "doc_id string, text string").select("*", *[F.lit(1).alias(c) for c in ("rep", "cluster", "s", "key", "id", "w")])
    found = find_duplicates(docs)
    assert [(r.cluster, r.size, float(r.similarity)) for r in found.clusters.collect()] == [("a", 2, 1.0)]
    assert {(r.cluster, r.id) for r in found.members.collect()} == {("a", "a"), ("a", "b")}
    assert find_duplicates(docs.limit(0)).clusters.count() == 0


def test_sets_are_not_repeated_for_every_shared_shingle(spark, monkeypatch):
    """Long texts that share most but too little meet in very many buckets; their sets aren't sent to each of them."""
    sent = []
    real = duplicates._paired

    def counted(rows, by, *more):
        sent.append(rows.count() if by == "key" else 0)
        return real(rows, by, *more)

    monkeypatch.setattr(duplicates, "_paired", counted)
    base = [f"w{i}" for i in range(3_000)]
    docs = [(k, " ".join(w if i % 40 != k else f"v{k}x{i}" for i, w in enumerate(base))) for k in range(4)]
    found = {r.cluster: (r.ids, float(r.similarity)) for r in duplicate_clusters(spark.createDataFrame(docs, "doc_id int, text string"), 0.9).collect()}
    assert found == brute_force(docs, 0.9) and sum(sent) == 0


def test_sets_are_made_only_for_texts_that_may_be_similar(spark, monkeypatch):
    """Texts that share a rare phrase but little else meet in buckets; the sketches tell them apart, few or many."""
    rng, made, real = random.Random(5), [], duplicates.Scratch.save

    def counted(self, df, name):
        out = real(self, df, name)
        made.append(out.count() if name == "sets" else 0)
        return out

    monkeypatch.setattr(duplicates.Scratch, "save", counted)
    for n in (20, 150):
        docs = [(k, " ".join(["seldom said so"] + [f"w{rng.randrange(10**6)}" for _ in range(60 + k % 3)])) for k in range(n)]
        docs += [(n, docs[0][1] + " more"), (n + 1, docs[1][1])]
        made.clear()
        found = {r.cluster: (r.ids, float(r.similarity)) for r in duplicate_clusters(spark.createDataFrame(docs, "doc_id int, text string")).collect()}
        assert found == brute_force(docs, 0.85) and sorted(found) == [0, 1] and 0 < max(made) <= 4


def test_sketches_never_leave_out_a_similar_pair():
    rng = np.random.default_rng(3)
    for size in (1, 2, 5, 63, 64, 65, 127, 129, 1000, 1030):
        for share in (0.8, 0.85, 0.9, 1.0):
            a = np.unique(rng.integers(-(1 << 62), 1 << 62, size))
            b = np.unique(np.concatenate([a[: int(np.ceil(len(a) * share))], rng.integers(-(1 << 62), 1 << 62, int(len(a) * (1 - share)))]))
            x, y = (np.frombuffer(duplicates._sketch(s), dtype=np.uint64) for s in (a, b))
            width = min(len(x), len(y))
            differ = int(np.bitwise_count(duplicates._folded(x, width) ^ duplicates._folded(y, width)).sum())
            assert differ <= len(np.setxor1d(a, b))
            common = len(np.intersect1d(a, b))
            if common >= 0.85 * (len(a) + len(b) - common):
                assert differ <= duplicates._apart(len(a) + len(b), 0.84995)
