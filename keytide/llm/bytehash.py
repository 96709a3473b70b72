"""Hashes of words, shingles and byte strings over whole Arrow batches of texts.

A block is a run of texts as one byte array with offsets. ``Prefix`` holds sums of table[b[i]] * B^i
modulo 2^64, from which the hash of any byte string of the block takes two reads; words and shingles
come from the same sums, so there is no loop over words in Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of a block; a longer text is a block of its own.
BLOCK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


@lru_cache(maxsize=8)
def table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, 256, dtype=U)


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK + 1)
        p = np.full(size, base, dtype=U)
        p[0] = 1
        have = np.cumprod(p, dtype=U)
        if size > 4 * BLOCK:  # powers for one very long text aren't kept
            return have
        _powers[base] = have
    return have[:n]


class Prefix:
    def __init__(self, data: np.ndarray, seed: int = 1) -> None:
        n = len(data)
        self.sums = np.zeros(n + 1, dtype=U)
        np.cumsum(table(seed)[data] * powers(BASE, n + 1)[:n], out=self.sums[1:])
        self.down = powers(INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def blocks(texts: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of ``texts``; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string()).cast(pa.large_binary())
    if not len(texts):
        return
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


#: Bytes between words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def word_bounds(data: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each text the number of words before it."""
    inside = ~space[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[offs[:-1][offs[:-1] < len(data)]] = False
    after[offs[1:][offs[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, offs)


def shingles(words: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``k`` following words and the text of each; a text of fewer words has one shingle of all."""
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n)), n)
    pos = np.arange(len(words)) - at[:-1][doc]
    first = (pos <= n[doc] - k) | (pos == 0)
    i, doc = np.flatnonzero(first), doc[first]
    h = np.full(len(i), k, dtype=U)
    padded = np.concatenate([words, np.zeros(k, U)])
    odd = table(77) | U(1)
    for j in range(k):
        h += np.where(pos[i] + j < n[doc], padded[i + j], U(0)) * odd[j]
    return mix(h), doc


def per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each text, modulo 2^64."""
    c = np.zeros(len(values) + 1, dtype=U)
    np.cumsum(values, out=c[1:])
    return c[at[1:]] - c[at[:-1]]


def word_digest(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64 bits of each text's sequence of words."""
    pos = (np.arange(len(words)) - np.repeat(at[:-1], np.diff(at))).astype(U)
    return mix(per_text(mix(words + pos * U(0xD6E8FEB86659FD93)), at) + np.diff(at).astype(U)).view(np.int64)
