"""Words, word hashes and word windows of whole texts, vectorised over Arrow blocks.

A word is a run of bytes outside ``\\x20\\x09-\\x0D`` of the UTF-8 text. Hashes are 64-bit, depend on the words alone
and are the same in every process. Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one numpy step works on; a longer text is a step of its own.
BLOCK_BYTES = 2_000_000

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_WRAP = 1 << 64


class _Powers:
    """Tables that a process fills for itself; functions that are sent to tasks take an empty one along."""

    tables = (np.ones(1, U64), np.ones(1, U64))

    def __reduce__(self):
        return type(self), ()


_powers = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (works in place on a copy)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_TABLE = mix(np.arange(1, 257, dtype=U64) * U64(_BASE))
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]


def _power_tables(n: int):
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_powers.tables[0]) < n:
        n = max(n, BLOCK_BYTES + 1)
        inverse = pow(_BASE, -1, _WRAP)
        tables = []
        for base in (_BASE, inverse):
            t = np.empty(n, U64)
            t[0], have = 1, 1
            while have < n:  # doubling: t[have + i] = t[i] * base ** have
                step = min(have, n - have)
                t[have:have + step] = t[:step] * U64(pow(base, have, _WRAP))
                have += step
            tables.append(t)
        if n > 8 * BLOCK_BYTES:
            return tables  # of one very long text: not kept
        _powers.tables = tuple(tables)
    return _powers.tables


@dataclass
class Words:
    """The words of a block of texts: byte data, word bounds, and for text i the words first[i]:first[i + 1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def __len__(self):
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def left(self) -> np.ndarray:
        """For each word, how many words its text has from there on."""
        return np.repeat(self.first[1:], self.counts()) - np.arange(len(self.starts))

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; ``lower`` takes A-Z as a-z."""
        if not len(self.starts):
            return np.empty(0, U64)
        return self.prefixes(lower)(None)

    def prefixes(self, lower: bool = False):
        """A function that hashes the first ``k`` bytes of each word; ``None`` and shorter words: the whole word."""
        up, down = _power_tables(len(self.data) + 1)
        sums = np.empty(len(self.data) + 1, U64)
        sums[0] = 0
        np.cumsum(np.take(_LOWER if lower else _TABLE, self.data) * up[:len(self.data)], out=sums[1:])

        def of(k):
            ends = self.ends if k is None else np.minimum(self.starts + k, self.ends)
            return mix((sums[ends] - sums[self.starts]) * down[self.starts])

        return of


def words_of(texts: pa.Array, space: np.ndarray = _SPACE) -> Words:
    """Words of the texts; ``space`` marks the bytes that separate them."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0]:offsets[-1]] if body is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    solid = ~space[data]
    begins, stops = solid.copy(), solid.copy()
    if len(data):
        begins[1:] &= ~solid[:-1]
        stops[:-1] &= ~solid[1:]
        edges = offsets[offsets < len(data)]
        begins[edges] = solid[edges]
        edges = offsets[offsets > 0] - 1
        stops[edges] = solid[edges]
    starts = np.flatnonzero(begins)
    return Words(data, starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each position; positions too near the end of the block are left out."""
    if len(hashes) < k:
        return np.empty(0, U64)
    n = len(hashes) - k + 1
    out = hashes[:n].copy()
    for i in range(1, k):
        out *= U64(0xD6E8FEB86659FD93)
        out += hashes[i:n + i]
    return mix(out)


def shingle_sets(words: Words, k: int = 5, lower: bool = True) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its ``k``-word shingles.

    A text of fewer than ``k`` words has its whole sequence as one shingle, a text without words none.
    """
    h = words.hashes(lower)
    w = windows(h, k)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(w[a:b - k + 1]))
        elif b > a:
            out.append(windows(h[a:b], b - a) ^ U64(b - a))  # never equals a shingle of k words but by chance
        else:
            out.append(np.empty(0, U64))
    return out


def blocks(batches: Iterator[pa.RecordBatch], column: str, size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``size`` bytes of text each; a longer text gets a slice of its own."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + size, "right")))
            yield batch.slice(at, to - at)
            at = to
