"""Vectorised word splitting and hashing over the bytes of Arrow string columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ._common import utf8

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word separators: the space and the bytes 9 to 13.
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
#: For classifiers, every ASCII byte that is no letter or digit separates.
PUNCT = np.ones(256, bool)
PUNCT[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, cached a worker long."""
    if len(have := _powers.get(int(base), np.ones(1, np.uint64))) < n:
        have = np.cumprod(np.r_[np.uint64(1), np.full(max(n, 1 << 20), base, np.uint64)])
        _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of a string column: byte spans, the document of each, and 64-bit hashes of the lower-cased words.

    ``first[d]:first[d + 1]`` are the words of document d. The hash of a span comes from prefix sums of
    byte * BASE**position modulo 2**64, shifted back to position 0 by the inverse power, then mixed.
    """

    def __init__(self, col: pa.Array, blank: np.ndarray = BLANK):
        self.raw, self.offsets = utf8(col)
        self.data = LOWER[self.raw]
        n = len(self.data)
        solid = ~blank[self.data]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], before[1:] = False, solid[:-1]
            after[-1], after[:-1] = False, solid[1:]
        self.start = np.flatnonzero(solid & (~before | edge[:-1]))
        self.end = np.flatnonzero(solid & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.doc = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))

    def hashes(self, stem: int | None = None) -> np.ndarray:
        """Hash of every word, or of its first ``stem`` bytes."""
        n = len(self.data)
        end = self.end if stem is None else np.minimum(self.end, self.start + stem)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=prefix[1:])
        return mix((prefix[end] - prefix[self.start]) * powers(INVERSE, n + 1)[self.start])


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of several aligned hash arrays; the order of the parts counts."""
    out = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + p + np.uint64(0x2545F4914F6CDD1D))
    return out


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words and the document of each; a shorter document is one run, an empty one none."""
    h, count = words.hashes(), np.diff(words.first)
    n = max(len(h) - size + 1, 0)
    inside = words.doc[:n] == words.doc[size - 1 :] if n else np.zeros(0, bool)
    runs = combine([h[i : i + n][inside] for i in range(size)]) if n else np.zeros(0, np.uint64)
    docs = words.doc[:n][inside]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        one = [combine([h[words.first[d] + i : words.first[d] + i + 1] for i in range(count[d])])[0] ^ np.uint64(int(count[d])) for d in short]
        runs, docs = np.r_[runs, np.array(one, np.uint64)], np.r_[docs, short]
    return runs, docs


def distinct(values: np.ndarray, docs: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each document, and the offsets of the documents."""
    order = np.lexsort((values, docs))
    values, docs = values[order], docs[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (docs[1:] != docs[:-1])
    values, docs = values[keep], docs[keep]
    return values, np.searchsorted(docs, np.arange(n_docs + 1))


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))
