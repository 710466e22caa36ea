"""SentencePiece encoding with N-best segmentation, and decoding.

A segmentation of a text is a path through the lattice of the model's pieces; its
score is the sum of the pieces' scores.  Forward Viterbi gives the best score of
every prefix.  Those are exact heuristics for an A-star search that runs
backward from the end: partial paths leave the queue in the order of the best
whole path they can become, so the first N complete ones are the N best.

No path can cover two neighbouring characters by one piece if no piece of the
model holds them side by side.  There the lattice falls into parts that are
searched once each; the best paths of a text are the best paths of its parts
with the smallest total loss, and only the N - 1 words that lose least can take
part in the N best of the whole.

The forward pass and the loss of the second best path are computed for all new
words of a batch at once, place by place; the backward search runs for the few
words whose alternatives can matter.
"""

from __future__ import annotations

import heapq
import itertools
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.durable import small_batches
from .words import pieces as runs

#: The mark that stands for a space, and what an unknown character costs below the worst piece.
SPACE, UNKNOWN_PENALTY = "▁", 10.0
#: Bytes that a task's memory of words, and that of alternatives, may take.
WORD_BYTES, OTHER_BYTES = 48 << 20, 8 << 20
#: Words of up to this many characters are searched together; longer ones part by part.
LONG = 64
#: Places of one search table, each with a score and an id for every piece length.
CELLS = 1 << 15
_PARTS = re.compile("▁*[^▁]+|▁+")
_CHARS = 0x110000


class Model:
    """Pieces of a SentencePiece file with byte fallback, as a lattice model."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.vocab_size()
        self.text = [sp.id_to_piece(i) for i in range(size)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(size)]
        self.pieces = {self.text[i]: (i, sp.get_score(i)) for i in range(size) if not special[i]}
        self.bytes = {sp.piece_to_id(f"<0x{b:02X}>"): b for b in range(256)}
        self.byte_id = {b: i for i, b in self.bytes.items()}
        # What pieces begin with: the piece itself, or None where only longer ones do.
        self.starts = {p[:k]: None for p in self.pieces for k in range(1, len(p))} | self.pieces
        self.unknown = min((s for _, s in self.pieces.values()), default=0.0) - UNKNOWN_PENALTY
        self.joined = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        self.splits_at_space = not any(SPACE in p.lstrip(SPACE) for p in self.pieces)
        self.library = sp
        self._trie()
        # What each id stands for; the row behind the last id stands for nothing.
        raw = [bytes([self.bytes[i]]) if i in self.bytes else t.replace(SPACE, " ").encode() for i, t in enumerate(self.text)] + [b""]
        self.raw = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.raw_size = np.array([len(x) for x in raw])
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size

    def _trie(self) -> None:
        """What pieces begin with, as a sorted table of (node, character) and the node behind; node 0 is the empty string."""
        node = {"": 0} | {p: i + 1 for i, p in enumerate(self.starts)}
        steps = sorted((node[p[:-1]] * _CHARS + ord(p[-1]), i) for p, i in node.items() if p)
        self.steps = np.array([k for k, _ in steps], dtype=np.int64)
        self.behind = np.array([i for _, i in steps], dtype=np.int64)
        hits = [None, *self.starts.values()]
        self.piece_at = np.array([-1 if h is None else h[0] for h in hits], dtype=np.int64)
        self.score_at = np.array([0.0 if h is None else h[1] for h in hits])
        self.longest = max(map(len, self.pieces), default=1)

    # The lattice of one part

    def edges_from(self, part: str, i: int) -> list[tuple[int, int, float]]:
        """(end, id, score) of the pieces that begin at i; id -1 is the unknown character."""
        found = []
        get = self.starts.get
        for j in range(i + 1, len(part) + 1):
            hit = get(part[i:j], False)
            if hit is False:  # no piece begins like this
                break
            if hit is not None:
                found.append((j, hit[0], hit[1]))
        if not found or found[0][0] != i + 1:
            found.insert(0, (i + 1, -1, self.unknown))
        return found

    def forward(self, part: str) -> tuple[list[float], list[list[tuple[int, int, float]]], list[tuple[int, int]]]:
        """Best score of each prefix, the pieces from each place, and the last piece of each best prefix."""
        n = len(part)
        best = [float("-inf")] * (n + 1)
        last = [(0, -1)] * (n + 1)
        best[0] = 0.0
        edges = []
        for i in range(n):
            own = self.edges_from(part, i)
            edges.append(own)
            b = best[i]
            for j, piece, score in own:
                total = b + score
                if total > best[j]:
                    best[j] = total
                    last[j] = (i, piece)
        return best, edges, last

    def _ids(self, part: str, path: list[tuple[int, int, int]]) -> list[int]:
        ids = []
        for i, j, piece in path:
            if piece >= 0:
                ids.append(piece)
            else:
                ids.extend(self.byte_id[b] for b in part[i:j].encode("utf-8", "surrogatepass"))
        return ids

    def best(self, part: str) -> tuple[float, float, np.ndarray]:
        """Best score of a part of any length, how much the second best path loses, and the ids."""
        best, edges, last = self.forward(part)
        n = len(part)
        path, j = [], n
        while j:
            i, piece = last[j]
            path.append((i, j, piece))
            j = i
        path.reverse()
        ids = self._ids(part, path)
        # Every other path has a piece outside the best one: the best such piece tells the loss.
        step = {i: j for i, j, _ in path}
        after = [float("-inf")] * n + [0.0]
        second = float("-inf")
        for i in range(n - 1, -1, -1):
            top, before, used = float("-inf"), best[i], step.get(i)
            for j, _, score in edges[i]:
                rest = score + after[j]
                if rest > top:
                    top = rest
                if j != used and before + rest > second:
                    second = before + rest
            after[i] = top
        return best[n], best[n] - second, np.array(ids, dtype=np.int32)

    def n_best(self, part: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best paths of a part: backward A-star over exact forward scores; ties go to longer last pieces."""
        best, edges, _ = self.forward(part)
        into: list[list[tuple[int, int, float]]] = [[] for _ in range(len(part) + 1)]
        for i, own in enumerate(edges):
            for j, piece, score in own:
                into[j].append((i, piece, score))
        order = itertools.count()
        queue = [(-best[-1], next(order), len(part), 0.0, None)]
        found = []
        while queue and len(found) < n:
            _, _, at, gained, chain = heapq.heappop(queue)
            if at == 0:
                path = []
                while chain:
                    path.append(chain[0])
                    chain = chain[1]
                found.append((gained, self._ids(part, path)))
                continue
            for i, piece, score in into[at]:
                heapq.heappush(queue, (-(best[i] + score + gained), next(order), i, gained + score, ((i, at, piece), chain)))
        return found

    # Many words at once

    def lattice(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of words: best scores, losses of the second best paths, numbers of ids, and all ids in a row."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        order = np.argsort(sizes, kind="stable")
        parts, at = [], 0
        while at < len(order):
            # Words of like length make one table; it holds a bounded number of places.
            longest = sizes[order[at]] * 5 // 4 + 1
            to = min(int(np.searchsorted(sizes[order], longest, "right")), at + max(1, CELLS // int(longest)))
            chosen = order[at:to]
            parts.append((chosen, *self._table([words[i] for i in chosen], sizes[chosen])))
            at = to
        if not parts:
            return np.zeros(0), np.zeros(0), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
        back = np.argsort(np.concatenate([x[0] for x in parts]))
        score, loss, count, ids = (np.concatenate([x[i] for x in parts]) for i in (1, 2, 3, 4))
        begin = (np.cumsum(count) - count)[back]
        count = count[back]
        return score[back], loss[back], count, ids[_ragged(begin, count)]

    def _table(self, words: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        m, n, width = len(words), int(sizes.max()), self.longest
        owner = np.repeat(np.arange(m), sizes)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        chars = np.zeros((n, m), dtype=np.int64)
        chars[inner, owner] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        # score and piece of the edge of k + 1 characters that ends before place i
        score = np.full((n + 1, width, m), -np.inf)
        piece = np.full((n + 1, width, m), -1, dtype=np.int32)
        score[inner + 1, 0, owner] = self.unknown
        at, k = np.zeros(len(owner), dtype=np.int64), 0
        while len(owner):  # all pieces from all places, one more character at a time
            key = at * _CHARS + chars[inner + k, owner]
            row = np.minimum(np.searchsorted(self.steps, key), len(self.steps) - 1)
            hit = self.steps[row] == key
            inner, owner, at = inner[hit], owner[hit], self.behind[row[hit]]
            k += 1
            ends = self.piece_at[at]
            whole = ends >= 0
            score[inner[whole] + k, k - 1, owner[whole]] = self.score_at[at[whole]]
            piece[inner[whole] + k, k - 1, owner[whole]] = ends[whole]
            on = inner + k < sizes[owner]
            inner, owner, at = inner[on], owner[on], at[on]
        best = np.full((n + 1, m), -np.inf)
        best[0] = 0
        back = np.zeros((n + 1, m), dtype=np.int64)  # characters of the last piece; the longest of equals
        for i in range(1, n + 1):
            k = min(i, width)
            total = best[i - k : i] + score[i, k - 1 :: -1]
            back[i] = k - total.argmax(axis=0)
            best[i] = total.max(axis=0)
        every = np.arange(m)
        taken = np.zeros((n, m), dtype=np.int64)
        now, live = sizes.copy(), every
        while len(live := live[now[live] > 0]):
            step = back[now[live], live]
            now[live] -= step
            taken[now[live], live] = step
        # Every other path has an edge outside the best one: the best such edge tells the loss.
        after = np.full((n + 1, m), -np.inf)
        after[sizes, every] = 0
        second = np.full(m, -np.inf)
        for i in range(n - 1, -1, -1):
            k = min(n - i, width)
            behind = score[np.arange(i + 1, i + k + 1), np.arange(k)] + after[i + 1 : i + k + 1]
            after[i] = np.maximum(after[i], behind.max(axis=0))
            used = np.flatnonzero(taken[i])
            behind[taken[i, used] - 1, used] = -np.inf
            second = np.maximum(second, best[i] + behind.max(axis=0))
        owner, inner = np.nonzero(taken.T)
        step = taken[inner, owner]
        ids, counts = piece[inner + step, step - 1, owner], np.ones(len(owner), dtype=np.int64)
        if len(strange := np.flatnonzero(ids < 0)):
            spelt = [[self.byte_id[b] for b in chr(chars[inner[i], owner[i]]).encode("utf-8", "surrogatepass")] for i in strange]
            counts[strange] = [len(x) for x in spelt]
            begin = (np.cumsum(counts) - counts)[strange]
            ids = np.repeat(ids, counts)
            for i, x in zip(begin, spelt, strict=True):
                ids[i : i + len(x)] = x
        total = best[sizes, every]
        return total, total - second, np.bincount(owner, counts, m).astype(np.int64), ids

    # Texts

    def split(self, word: str) -> list[str]:
        """Parts of a word between which no piece reaches."""
        cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.joined]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)]

    def cut(self, text: str) -> list[str]:
        """Words with their leading space marks."""
        if not text:
            return []
        marked = SPACE + text.replace(" ", SPACE)
        if not self.splits_at_space:
            return [marked]
        return _PARTS.findall(marked)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of id lists laid end to end; bytes are put together, and the first space of a text is dropped."""
        sizes = self.raw_size[ids]
        stops = np.cumsum(sizes)
        data = self.raw[_ragged(self.raw_at[ids], sizes)].tobytes()
        edges = np.concatenate(([0], stops))[np.concatenate(([0], np.cumsum(counts)))].tolist()
        return [data[a + (data[a : a + 1] == b" ") : b].decode("utf-8", "replace") if b > a else "" for a, b in itertools.pairwise(edges)]


def _ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for size[0] values, then those of the next one."""
    stops = np.cumsum(size)
    return np.repeat(begin - (stops - size), size) + np.arange(int(stops[-1]) if len(stops) else 0)


class Segmenter:
    """Encodes texts; one task's memory of words, emptied when it is full and gone with the task."""

    def __init__(self, model: Model, merged: bool = False):
        self.model, self.merged = model, merged
        self.others: dict[tuple[str, int], list[tuple[float, list[int]]]] = {}
        self.others_held = 0
        self._clear()

    def _clear(self) -> None:
        self.row: dict[str, int] = {}
        self.held = 0
        self.score = self.loss = np.zeros(0)
        self.size, self.ids, self.at = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
        self.merged_size, self.merged_ids, self.merged_at = self.size, self.ids, self.at

    def rows(self, words: list[str]) -> np.ndarray:
        """Rows of words in the memory, which learns the new ones."""
        found = list(map(self.row.get, words))
        if None in found:
            if self.held > WORD_BYTES:
                self._clear()
            row = self.row
            self._learn(list(dict.fromkeys(w for w in words if w not in row)))
            found = list(map(row.__getitem__, words))
        return np.array(found, dtype=np.int64)

    def _learn(self, new: list[str]) -> None:
        short = [w for w in new if len(w) <= LONG]
        score, loss, size, ids = self.model.lattice(short)
        if len(short) < len(new):
            long = [w for w in new if len(w) > LONG]
            made = list(map(self._long, long))
            score, loss = (np.concatenate((a, [m[i] for m in made])) for a, i in ((score, 0), (loss, 1)))
            size = np.concatenate((size, [len(m[2]) for m in made]))
            ids = np.concatenate((ids, *(m[2] for m in made)))
            short = short + long
        self.row.update(zip(short, range(len(self.score), len(self.score) + len(short)), strict=True))
        self.at = np.concatenate((self.at, len(self.ids) + np.cumsum(size) - size))
        self.score, self.loss, self.size, self.ids = (np.concatenate(p) for p in ((self.score, score), (self.loss, loss), (self.size, size), (self.ids, ids)))
        self.held += 250 * len(short) + 4 * len(ids) + 2 * sum(map(len, short))
        if self.merged:  # merges never reach over a space, so the library may take words one by one
            own = self.model.library.encode([w[1:].replace(SPACE, " ") for w in short], num_threads=1)
            size = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
            ids = np.fromiter(itertools.chain.from_iterable(own), dtype=np.int32, count=int(size.sum()))
            self.merged_at = np.concatenate((self.merged_at, len(self.merged_ids) + np.cumsum(size) - size))
            self.merged_size, self.merged_ids = np.concatenate((self.merged_size, size)), np.concatenate((self.merged_ids, ids))
            self.held += 4 * len(ids)

    def _long(self, word: str) -> tuple[float, float, np.ndarray]:
        """A long word from its parts."""
        parts = self.model.split(word)
        short = list(dict.fromkeys(p for p in parts if len(p) <= LONG))
        score, loss, size, ids = self.model.lattice(short)
        known = {p: (s, x, i) for p, s, x, i in zip(short, score, loss, np.split(ids, np.cumsum(size)[:-1]) if short else (), strict=True)}
        for p in parts:
            if p not in known:
                known[p] = self.model.best(p)
        own = [known[p] for p in parts]
        return float(sum(x[0] for x in own)), float(min(x[1] for x in own)), np.concatenate([x[2] for x in own])

    def alternatives(self, part: str, n: int) -> list[tuple[float, list[int]]]:
        """``n_best`` of a part, remembered."""
        found = self.others.get((part, n))
        if found is None:
            found = self.model.n_best(part, n)
            if self.others_held > OTHER_BYTES:
                self.others.clear()
                self.others_held = 0
            self.others[part, n] = found
            self.others_held += 300 + 2 * len(part) + sum(100 + 16 * len(ids) for _, ids in found)
        return found

    def encode(self, texts: list[str | None], n: int) -> tuple[tuple[np.ndarray, np.ndarray], list[list[tuple[float, tuple]]], tuple[np.ndarray, np.ndarray]]:
        """All ids in a row and their number in each text; of each text the n best as (score, edits); ids by merges and their numbers.

        An edit is (first id, behind the last, new ids).
        """
        words = [self.model.cut(t or "") for t in texts]
        flat = list(itertools.chain.from_iterable(words))
        rows = self.rows(flat)
        counts = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        owner = np.repeat(np.arange(len(texts)), counts)

        def joined(ids: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            own = size[rows] if len(size) else np.zeros(0, dtype=np.int64)
            return ids[_ragged(at[rows], own)] if len(size) else ids, np.bincount(owner[: len(own)], own, len(texts)).astype(np.int64)

        best = joined(self.ids, self.at, self.size)
        by_merges = joined(self.merged_ids, self.merged_at, self.merged_size)
        totals = np.bincount(owner, self.score[rows], len(texts))
        stops, losses = np.cumsum(self.size[rows]), self.loss[rows]
        starts = stops - self.size[rows]
        first = np.cumsum(counts) - counts
        near: list[list[int]] = []  # of each text, the words that lose least by a change
        for a, size in zip(first.tolist(), counts.tolist(), strict=True):
            own = losses[a : a + size]
            some = (_smallest(own, n - 1) if size >= n else np.arange(size)) if n > 1 else np.arange(0)
            near.append(sorted(some[own[some] < np.inf].tolist()))
        parts = {flat[a + w]: self.model.split(flat[a + w]) for a, own in zip(first.tolist(), near, strict=True) for w in own}
        every = list(dict.fromkeys(itertools.chain.from_iterable(parts.values())))
        at = self.rows(every)
        found = {p: (s, i.tolist()) for p, s, i in zip(every, self.score[at].tolist(), np.split(self.ids[_ragged(self.at[at], self.size[at])], np.cumsum(self.size[at])[:-1]) if every else (), strict=True)}
        paths: list[list[tuple[float, tuple]]] = []
        for i, total in enumerate(totals.tolist()):
            kept: list[tuple[float, tuple, tuple]] = [(0.0, (), ())]
            for w in near[i]:
                j = int(first[i]) + w
                start = int(starts[j] - starts[first[i]])
                for k, part in enumerate(parts[flat[j]]):
                    score, own = found[part]
                    others = [(s, new) for s, new in self.alternatives(part, n) if new != own][: n - 1]
                    changes = [(score - s, ((w, k, rank),), ((start, start + len(own), new),)) for rank, (s, new) in enumerate(others)]
                    # The n smallest losses so far; ties go to the changes further left.
                    kept = heapq.nsmallest(n, kept + [(x[0] + y[0], x[1] + y[1], x[2] + y[2]) for x in kept for y in changes], key=lambda c: c[:2])
                    start += len(own)
            paths.append([(total - loss, edits) for loss, _, edits in kept])
        return best, paths, by_merges


def _smallest(x: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest values, the first ones among equals."""
    limit = np.partition(x, k - 1)[k - 1]
    below = np.flatnonzero(x < limit)
    return np.concatenate((below, np.flatnonzero(x == limit)[: k - len(below)]))


@lru_cache(2)
def _model(path: str) -> Model:
    return Model(path)


_IDS = pa.list_(pa.int32())
_ENCODED = pa.struct([("score", pa.float64()), ("edits", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("ids", _IDS)])))])


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(ids, pa.int32()))


def encode(
    docs: DataFrame, model_path: str, n: int = 4, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), merged: bool = False
) -> DataFrame:
    """N-best segmentations of every whole text under the model file (on every machine at ``model_path``).

    Returns a row per input row: ``id_col``, the columns named in ``keep``,
    ids (the best path) and n_best, an array of (score, edits) from best to
    worst; applying the edits (ids [start, stop) replaced by others) to ``ids``
    gives that path.  Paths are those of the piece lattice, spaces as marks
    behind one added mark; a character without a piece becomes its bytes.

    A model of the BPE kind was trained with merges, whose order its scores
    tell; ``merged`` adds merged_ids, the ids that the library gives by them.

    * null or empty text: no ids, and one path of score 0;
    * very long texts and words: encoded whole;
    * a text with fewer than n paths has all of them;
    * equal scores: the change further left comes first;
    * null ids and repeated rows: encoded one by one;
    * empty table: empty result; other columns, whatever their names, are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(model_path)
        segmenter = Segmenter(model, merged)
        for batch in batches:
            for part in runs(batch, 1):
                texts = part.column(1).to_pylist()
                own, paths, by_merges = segmenter.encode(texts, n)
                best = [[{"score": s, "edits": [{"start": a, "stop": b, "ids": new} for a, b, new in edits]} for s, edits in found] for found in paths]
                columns = [_lists(*own), pa.array(best, pa.list_(_ENCODED)), *([_lists(*by_merges)] if merged else [])]
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], *columns], schema.names)

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_body"), *keep)
    schema = T.StructType([rows.schema[c] for c in (id_col, *keep)])
    edit = T.StructType().add("start", T.IntegerType()).add("stop", T.IntegerType()).add("ids", T.ArrayType(T.IntegerType()))
    path = T.StructType().add("score", T.DoubleType()).add("edits", T.ArrayType(edit))
    schema.add("ids", T.ArrayType(T.IntegerType())).add("n_best", T.ArrayType(path))
    if merged:
        schema.add("merged_ids", T.ArrayType(T.IntegerType()))
    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """Texts of id arrays: ``id_col``, the columns named in ``keep``, decoded.

    * null or empty array: the empty text; null elements stand for nothing;
    * bytes that are no UTF-8: replaced by U+FFFD;
    * null ids and repeated rows: decoded one by one;
    * empty table: empty result; other columns, whatever their names, are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(model_path)
        for batch in batches:
            lists = batch.column(1)
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = lists.flatten().fill_null(len(model.text)).to_numpy(zero_copy_only=False)
            texts, at, place = [], 0, 0
            while at < len(counts):  # about a million ids at a time
                to = max(at + 1, int(np.searchsorted(np.cumsum(counts[at:]), 1 << 20)) + at)
                size = int(counts[at:to].sum())
                texts += model.decode(ids[place : place + size], counts[at:to])
                at, place = to, place + size
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(texts, pa.string())], schema.names)

    rows = encoded.select(F.col(id_col), F.col(ids_col).alias("_ids"), *keep)
    schema = T.StructType([rows.schema[c] for c in (id_col, *keep)]).add("decoded", T.StringType())
    return rows.mapInArrow(run, schema)
