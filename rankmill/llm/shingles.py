"""Word shingles of many texts at once, as sorted arrays of 64-bit hashes, and their MinHash signatures."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
BLOCK = 1 << 20  # bytes hashed at once; a longer word makes its block longer
_BASE = 0x9E3779B97F4A7C13  # odd, 3 modulo 8
_SLOTS = [0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB]


def _mix(x: np.ndarray) -> np.ndarray:
    """The finishing step of a 64-bit generator: each input bit reaches each output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Holds the tables of powers that all texts of a task share."""

    def __init__(self, words: int = WORDS) -> None:
        self.words = words
        self._grow(BLOCK)
        space = np.zeros(256, bool)
        space[[0x20, *range(0x09, 0x0E)]] = True
        lower = np.arange(1, 257, dtype=np.uint64)
        lower[65:91] += np.uint64(32)
        self.space, self.lower = space, lower

    def _grow(self, n: int) -> None:
        inverse = pow(_BASE, -1, 1 << 64)
        self.powers, self.inverses = (np.full(n + 1, b, np.uint64) for b in (_BASE, inverse))
        self.powers[0] = self.inverses[0] = 1
        for table in (self.powers, self.inverses):
            np.cumprod(table, out=table)

    def word_hashes(self, raw: np.ndarray) -> np.ndarray:
        """A hash for each word of the UTF-8 bytes, A-Z as a-z."""
        gap = self.space[raw]
        edges = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).view(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        out, at = np.empty(len(starts), np.uint64), 0
        while at < len(starts):
            upto = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, "right")))
            first, last = starts[at], ends[upto - 1]
            if last - first > len(self.powers) - 1:
                self._grow(int(last - first))
            sums = np.zeros(last - first + 1, np.uint64)
            np.cumsum(self.lower[raw[first:last]] * self.powers[: last - first], out=sums[1:])
            s, e = starts[at:upto] - first, ends[at:upto] - first
            out[at:upto] = _mix((sums[e] - sums[s]) * self.inverses[s] + (e - s).astype(np.uint64))
            at = upto
        return out

    def hashes(self, raw: np.ndarray) -> np.ndarray:
        """Sorted distinct hashes of the shingles; a text of fewer words is one shingle, one without words has none."""
        words = self.word_hashes(raw)
        k = self.words
        if not len(words):
            return words
        if len(words) < k:
            whole = (words * np.array(_SLOTS[: len(words)], np.uint64)).sum(keepdims=True, dtype=np.uint64)
            return _mix(whole + np.uint64(len(words)))
        joined = np.full(len(words) - k + 1, k, np.uint64)
        for i in range(k):
            joined += words[i : len(words) - k + 1 + i] * np.uint64(_SLOTS[i])
        return np.unique(_mix(joined))


def raw_texts(column: pa.Array) -> Iterator[np.ndarray]:
    """The UTF-8 bytes of each text without a copy; a missing one is empty."""
    wide = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = np.frombuffer(wide.buffers()[2] or b"", np.uint8)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        yield data[a:b]


class MinHasher:
    """Signatures of ``size`` 32-bit minima under multiply-add hash functions with fixed seeds."""

    def __init__(self, size: int, seed: int = 7) -> None:
        draw = np.random.default_rng(seed).integers(0, 1 << 63, (2, size), dtype=np.uint64)
        self.factors, self.terms = (draw[0] * np.uint64(2) + np.uint64(1))[:, None], draw[1][:, None]

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(self.factors), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(hashes), 2048):
            np.minimum(out, (hashes[None, i : i + 2048] * self.factors + self.terms).min(axis=1), out=out)
        return (out >> np.uint64(32)).astype(np.uint32)


def digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
