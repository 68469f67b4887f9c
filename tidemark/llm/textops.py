"""Vectorised word spans and hashes over Arrow batches of UTF-8 text.

Helpers for functions that run inside Spark tasks. A text is handled whole; a null text is an empty one.
Words are maximal runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
_ODD = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xD6E8FEB86659FD93)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NO_WORD = np.zeros(256, dtype=bool)  # all of ASCII but digits and letters
NO_WORD[:0x80] = True
NO_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, for positions below ``n``."""
    if len(_powers[0]) < n:
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        for k, base in enumerate((_ODD, inverse)):
            row = np.full(max(n, CHUNK_BYTES), base, dtype=np.uint64)
            row[0] = 1
            _powers[k] = np.multiply.accumulate(row)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the word."""
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _ODD
    return h ^ (h >> np.uint64(32))


class Words:
    """Words of consecutive texts: lower-cased bytes, spans, and each text's range of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACE):
        self.raw = data
        self.data = LOWER[data]
        self.offsets = offsets
        solid = ~gaps[data]
        first = np.zeros(len(data) + 1, dtype=bool)
        first[offsets] = True
        start = solid.copy()
        start[1:] &= ~solid[:-1] | first[1:-1]
        end = solid.copy()
        end[:-1] &= ~solid[1:] | first[1:-1]
        self.starts = np.flatnonzero(start)
        self.ends = np.flatnonzero(end) + 1
        self.bounds = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word, equal for equal words in any batch."""
        n = len(self.data)
        if not n:
            return np.zeros(0, dtype=np.uint64)
        up, down = _power_tables(n)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        return mix((total[self.ends] - total[self.starts]) * down[self.starts])


def chunks(texts: pa.Array, gaps: np.ndarray = SPACE) -> Iterator[tuple[int, Words]]:
    """Words (between bytes of ``gaps``) of a batch in pieces of about ``CHUNK_BYTES``, a longer text alone, with the index of the first text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    if not len(texts):
        return
    _, at, body = texts.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, side="right")) - 1)
        j = min(j, len(texts))
        yield i, Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], gaps)
        i = j


class Lookup:
    """Positions of 64-bit keys in a fixed key set, found through their mixed values' top bits."""

    def __init__(self, keys: np.ndarray):
        mixed = mix(keys.astype(np.uint64))
        self.order = np.argsort(mixed, kind="stable").astype(np.int32)
        bits = max(1, int(len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.sorted = np.append(mixed[self.order], ~np.uint64(0))
        self.starts = np.searchsorted(self.sorted[:-1], np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key in the set, or -1."""
        mixed = mix(keys)
        at = self.starts[mixed >> self.shift].astype(np.int64)
        wait = np.flatnonzero(self.sorted[at] < mixed)
        while len(wait):
            at[wait] += 1
            wait = wait[self.sorted[at[wait]] < mixed[wait]]
        hit = self.sorted[at] == mixed
        hit &= at < len(self.order)
        found = np.full(len(keys), -1, dtype=np.int64)
        found[hit] = self.order[at[hit]]
        return found


def tallied(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts by key over parts of ``(keys, counts)``."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def signed(h: np.ndarray) -> pa.Array:
    """Unsigned 64-bit values as the bit-equal signed ones Spark holds."""
    return pa.array(h.view(np.int64))
