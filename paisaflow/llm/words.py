"""Words of a batch of texts as numpy arrays, from one pass over the bytes.

Texts are taken in chunks of a few megabytes, so a task's memory does not depend on how many
rows an Arrow batch holds; one longer text makes a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


class Chunk(NamedTuple):
    first: int             # row of the batch at which the chunk starts
    data: np.ndarray       # bytes of all its texts, one after the other
    offsets: np.ndarray    # where each text starts, and the end of the last

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


class Words(NamedTuple):
    hash: np.ndarray       # 64 bits per word
    start: np.ndarray      # first byte
    end: np.ndarray        # byte after the last
    first: np.ndarray      # per text the index of its first word, and the number of words


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_table(fold: bool) -> np.ndarray:
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    if fold:
        table[ord("A"):ord("Z") + 1] = table[ord("a"):ord("z") + 1]
    return table


_TABLES = {fold: _byte_table(fold) for fold in (False, True)}
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: all ASCII but digits and letters
NOT_ALPHANUMERIC = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, up to ``n``."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 2 * len(_powers[0]), CHUNK_BYTES + 1)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The texts in order, null as empty, about ``limit`` bytes at a time."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if len(texts) == 0:
        return
    _, where, data = texts.buffers()
    ends = np.frombuffer(where, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = int(np.searchsorted(ends, ends[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), len(texts))
        yield Chunk(lo, raw[ends[lo]:ends[hi]], ends[lo:hi + 1] - ends[lo])
        lo = hi


def prefix_hashes(data: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Running sums from which the hash of any byte range follows, and the inverse powers."""
    power, inverse = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLES[fold][data] * power[:len(data)], out=sums[1:])
    return sums, inverse


def range_hash(sums, inverse, start, end) -> np.ndarray:
    size = (end - start).astype(np.uint64) if isinstance(end, np.ndarray) else np.uint64(0)
    return mix((sums[end] - sums[start]) * inverse[start] + size)


def word_places(chunk: Chunk, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start``, ``end`` and ``first`` of ``Words``: runs of bytes other than those ``between`` marks."""
    data, offsets = chunk.data, chunk.offsets
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(chunk.rows + 1, np.int64)
    inside = ~between[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


def words(chunk: Chunk, fold: bool = False, between: np.ndarray = _SPACE) -> Words:
    """Runs of bytes other than those ``between`` marks; ``fold`` hashes A-Z as a-z."""
    start, end, first = word_places(chunk, between)
    if len(chunk.data) == 0:
        return Words(start.astype(np.uint64), start, end, first)
    sums, inverse = prefix_hashes(chunk.data, fold)
    return Words(range_hash(sums, inverse, start, end), start, end, first)


def sequence_hash(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` consecutive words, across all texts of the chunk."""
    if len(hashes) < length:
        return np.zeros(0, np.uint64)
    out = np.full(len(hashes) - length + 1, np.uint64(length), np.uint64)
    factor = np.uint64(_BASE)
    for k in range(length):
        out = out * factor + hashes[k:k + len(out)]
    return mix(out)


def shingle_sets(chunk: Chunk, length: int, fold: bool = True) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its ``length``-word shingles.

    A text of fewer words has its whole sequence as one shingle; without words none.
    """
    found = words(chunk, fold)
    runs = sequence_hash(found.hash, length)
    out = []
    for lo, hi in zip(found.first[:-1], found.first[1:]):
        if hi - lo >= length:
            out.append(np.unique(runs[lo:hi - length + 1]))
        elif hi > lo:
            out.append(sequence_hash(found.hash[lo:hi], int(hi - lo)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
