"""Words of whole texts as 64-bit hashes, found for all texts of a batch at once.

A word is a run of bytes other than space, tab, LF, VT, FF and CR.  Its hash is
a polynomial of its bytes, taken from running sums over the batch, so hardly
any word is ever an object of its own.  Polynomials modulo a power of two have
equal values for certain long words, whatever the base is; so words of more
than ``LONG`` bytes are hashed by BLAKE2b instead.  Texts of any length are
hashed in segments of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at a time, and of texts handed on together.
SEGMENT, TOGETHER = 1 << 19, 1 << 21
#: Longest word, in bytes, that its polynomial stands for.
LONG = 128
_BASE = 0x9E3779B97F4A7C15 | 1
_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_AS_IS = np.arange(1, 257, dtype=np.uint64)
_LOWER = _AS_IS.copy()
_LOWER[65:91] += np.uint64(32)
_tables: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse."""
    if not _tables or len(_tables[0]) < n:
        size = max(n, SEGMENT + 1024)
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            table = np.full(size + 1, base, dtype=np.uint64)
            table[0] = 1
            _tables.append(np.cumprod(table))
        del _tables[:-2]
    return _tables


@dataclass
class Words:
    hashes: np.ndarray
    start: np.ndarray  # first byte
    stop: np.ndarray  # behind the last byte
    text: np.ndarray  # which text it is in
    first: np.ndarray  # first word of each text, and behind the last one


def split(data: np.ndarray, offsets: np.ndarray, lower: bool) -> Words:
    """Words of the texts ``data[offsets[i]:offsets[i + 1]]``; A-Z count as a-z if ``lower``."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = ~_GAP[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    start = np.flatnonzero(inside[1:-1] & (cut[:-1] | ~inside[:-2]))
    stop = np.flatnonzero(inside[1:-1] & (cut[1:] | ~inside[2:])) + 1
    hashes = np.empty(len(start), dtype=np.uint64)
    values = _LOWER if lower else _AS_IS
    at = 0
    while at < len(start):  # whole words at a time
        begin = start[at]
        to = max(at + 1, int(np.searchsorted(stop, begin + SEGMENT, "right")))
        size = int(stop[to - 1] - begin)
        power, inverse = _powers(size)
        sums = np.empty(size + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(values[data[begin : begin + size]] * power[:size], out=sums[1:])
        s = start[at:to] - begin
        hashes[at:to] = mix((sums[stop[at:to] - begin] - sums[s]) * inverse[s])
        at = to
    for i in np.flatnonzero(stop - start > LONG):
        word = (values[data[start[i] : stop[i]]] - np.uint64(1)).astype(np.uint8)
        hashes[i] = int.from_bytes(blake2b(word.tobytes(), digest_size=8).digest(), "little")
    first = np.searchsorted(start, offsets)
    return Words(hashes, start, stop, np.repeat(np.arange(len(offsets) - 1), np.diff(first)), first)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of rows that hold about ``TOGETHER`` bytes of text."""
    _, offsets = texts_of(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + TOGETHER, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
