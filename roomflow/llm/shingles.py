"""Word shingle sets of whole texts, as 64-bit hashes, and their minwise tokens."""

from __future__ import annotations

from itertools import chain

import numpy as np
import xxhash

KNOWN = 250_000


class _WordHash(dict):
    """Hashes of words; the first ``KNOWN`` ones that a worker meets are remembered."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < KNOWN and len(word) <= 40:
            self[word] = h
        return h


_HASH = _WordHash()


def shingle_sets(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, one text after another, and how many each text has.

    Words are runs without ASCII white space, with A-Z lower-cased. A text with fewer than ``size`` words has its whole
    sequence as its one shingle; a text without words has none.
    """
    words = [(t or "").encode().lower().split() for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter(map(_HASH.__getitem__, chain.from_iterable(words)), np.uint64, int(counts.sum()))
    ends = np.cumsum(counts)
    out, sizes = [], np.zeros(len(words), np.int64)
    with np.errstate(over="ignore"):
        rolled = _roll(flat, size)
        for i, (n, end) in enumerate(zip(counts.tolist(), ends.tolist(), strict=True)):
            if n >= size:
                got = np.unique(rolled[end - n : end - size + 1])
            elif n:
                got = _roll(flat[end - n : end], n) ^ np.uint64(n)  # never equal to a full shingle
            else:
                continue
            out.append(got)
            sizes[i] = len(got)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), sizes


def _roll(flat: np.ndarray, size: int) -> np.ndarray:
    n = max(0, len(flat) - size + 1)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = (h ^ flat[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h


def minwise(sets: np.ndarray, sizes: np.ndarray, count: int, seed: int = 7) -> np.ndarray:
    """A row of ``count`` minwise tokens (32 bits) for each set that isn't empty."""
    rng = np.random.default_rng(seed)
    multiply = rng.integers(1, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    flip = rng.integers(0, 2**63, count, dtype=np.uint64)
    sizes = sizes[sizes > 0]
    out = np.zeros((len(sizes), count), np.uint64)
    ends = np.cumsum(sizes)
    cuts = np.searchsorted(ends // 65_536, np.arange(int(ends[-1]) // 65_536 + 1 if len(ends) else 0))
    for rows in np.split(np.arange(len(sizes)), cuts[1:]):
        if len(rows) == 0:
            continue
        first = ends[rows[0]] - sizes[rows[0]]
        part, starts = sets[first : ends[rows[-1]]], ends[rows] - sizes[rows] - first
        with np.errstate(over="ignore"):
            for k in range(count):
                out[rows, k] = np.minimum.reduceat((part ^ flip[k]) * multiply[k], starts)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return (out >> np.uint64(32)).astype(np.uint32)
