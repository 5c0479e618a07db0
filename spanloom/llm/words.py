"""Words of many texts at once as 64-bit hashes, in numpy.

A word is a run of bytes other than 0x20 and 0x09-0x0D.  Its hash depends on its bytes
alone: a polynomial over 2^64 with an odd base, whose prefix sums give any substring, mixed
at the end.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

from spanloom.llm.common import raw

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
MASK = (1 << 64) - 1
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes hashed at a time; only a single longer word goes beyond.
BLOCK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (the splitmix64 finaliser)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@lru_cache(None)
def byte_values(lower: bool) -> np.ndarray:
    v = mix(np.arange(1, 257, dtype=np.uint64) * U(BASE))
    if lower:
        v[65:91] = v[97:123]
    return v


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^0 .. BASE^(n-1) and their inverses, modulo 2^64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((BASE, INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """n + 1 prefix sums; ``span_hash`` takes the hash of any span from them."""
    p, _ = powers(max(len(data), 1))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_values(lower)[data] * p[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, q = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * q[start] + (end - start).astype(np.uint64) * U(0xD6E8FEB86659FD93))


@dataclass
class Words:
    """Words of n texts in order: text number, byte span within all texts, hash; ``at``: n + 1 word offsets."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    at: np.ndarray


def words(texts: pa.Array, lower: bool = True) -> Words:
    """Every word of ``texts``; ``lower`` takes A-Z as a-z."""
    data, at = raw(texts)
    n = len(data)
    inside = ~SPACE[data]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    cuts = at[1:-1]
    before[cuts[cuts < n]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[cuts[(cuts > 0)] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    hashes = np.empty(len(start), np.uint64)
    row = 0
    while row < len(start):
        stop = max(row + 1, int(np.searchsorted(end, start[row] + BLOCK, "right")))
        a, b = start[row], end[stop - 1]
        hashes[row:stop] = span_hash(prefix_hash(data[a:b], lower), start[row:stop] - a, end[row:stop] - a)
        row = stop
    doc = np.searchsorted(at, start, "right") - 1
    return Words(doc, start, end, hashes, np.searchsorted(doc, np.arange(len(texts) + 1)))


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of k successive words of one text, each with its text and first word."""
    n = len(w.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(w.doc[:n] == w.doc[k - 1 :])
    return chained(w.hash, first, k), w.doc[first], first


def chained(h: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(len(first), np.uint64)
    for j in range(k):
        out = mix(out + h[first + j])
    return out


def shingle_sets(w: Words, n_texts: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, and their number.

    A text of fewer than k words, but one at least, has its whole sequence as one shingle.
    """
    values, doc, _ = shingles(w, k)
    count = np.diff(w.at)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        extra = np.array([chained(w.hash, w.at[d : d + 1], int(count[d]))[0] for d in short], np.uint64)
        values, doc = np.concatenate([values, mix(extra ^ U(k))]), np.concatenate([doc, short])
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    values, doc = values[keep], doc[keep]
    return values, np.bincount(doc, minlength=n_texts).astype(np.int64)
