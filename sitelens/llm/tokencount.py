"""Token counts with a whole-token shortcut.

A text is cut into pre-tokens by the vocabulary's own pattern.  For every
vocabulary string it is proved beforehand, once, whether the library gives it
exactly one token when it stands alone as a pre-token; such pre-tokens count as
one.  Only the rest are merged, each distinct one once a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.durable import small_batches

#: Fixed value: the pattern that byte-level vocabularies of this family split texts by.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Merged pre-tokens a task remembers (about 150 bytes each); beyond it starts anew.
REMEMBERED = 1_000_000
#: Pre-tokens longer than this are merged each time instead of being remembered.
LONG = 64


class Counter:
    """Counts tokens as the library does for a byte-level BPE file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.whole = dict.fromkeys(self.proved(), 1)
        self.merged: dict[str, int] = {}
        self.pieces = _pattern().findall

    def proved(self) -> list[str]:
        """Vocabulary strings that are one pre-token and encode alone as one token."""
        tokenizer = self.tokenizer
        strings = [tokenizer.decode([i], skip_special_tokens=False) for i in range(tokenizer.get_vocab_size())]
        # A piece of a character decodes to U+FFFD and proves nothing.
        strings = [s for s in dict.fromkeys(strings) if s and "�" not in s and s not in self.special]
        find = _pattern().findall
        encoded = tokenizer.encode_batch_fast(strings, add_special_tokens=False)
        return [s for s, e in zip(strings, encoded, strict=True) if len(e.ids) == 1 and find(s) == [s]]

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        if self.split is None or not any(s in text for s in self.special):
            return self._count(text)
        parts = self.split.split(text)
        return sum(map(self._count, parts)) + len(parts) - 1

    def _count(self, text: str) -> int:
        pieces = self.pieces(text)
        counts = list(map(self.whole.get, pieces))
        rest = [p for p, n in zip(pieces, counts, strict=True) if n is None]
        total = len(counts) - len(rest)
        if rest:
            known = list(map(self.merged.get, rest))
            new = [p for p, n in zip(rest, known, strict=True) if n is None]
            total += sum(n for n in known if n)
            if new:
                total += self._merge(new)
        return total

    def _merge(self, pieces: list[str]) -> int:
        """Merges of each distinct piece, remembered for later texts; the tokens of all the pieces."""
        distinct = list(dict.fromkeys(pieces))
        made = {p: len(e) for p, e in zip(distinct, self.tokenizer.encode_batch_fast(distinct, add_special_tokens=False), strict=True)}
        if len(self.merged) + len(made) > REMEMBERED:
            self.merged.clear()
        self.merged |= {p: n for p, n in made.items() if len(p) <= LONG}
        return sum(map(made.__getitem__, pieces))


@lru_cache(1)
def _pattern():
    import regex

    return regex.compile(PATTERN)


@lru_cache(2)
def _counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(
    docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Tokens of every whole text under the vocabulary file (on every machine at ``tokenizer_path``).

    Returns a row per input row: ``id_col``, n_bytes (UTF-8), n_tokens,
    over_limit (n_tokens > limit).  No begin, end or added special tokens;
    special strings inside a text count as the library's default takes them.

    * null text: as empty, no bytes and no tokens;
    * null ids and repeated rows: counted one by one;
    * empty table: empty result; other columns, whatever their names, are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer_path)
        for batch in batches:
            counts = [counter.count(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    small_batches(docs.sparkSession)
    text: Column = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("bigint").alias("n_bytes"), text.alias("body"))
    counted = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
