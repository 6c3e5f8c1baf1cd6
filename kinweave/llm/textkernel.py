"""Vectorised hashing of words and word k-grams over the UTF-8 bytes of many texts at once."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@functools.lru_cache(maxsize=4)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base mod 2**64 and of its inverse."""
    with np.errstate(over="ignore"):
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    # Few sizes, so that a worker holds few tables: one for words, one for the bytes of a usual chunk; a longer text's own go with it.
    size = next((s for s in (1 << 18, (1 << 20) + 64) if n < s), None)
    return _powers.__wrapped__(base, n) if size is None else _powers(base, size)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0xA0761D6478BD642F + 0x9E3779B97F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts in a row, and where each text starts, with the end as last; null: empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pa.compute.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if len(texts) == 0 or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, a polynomial: texts can be made to clash, so compare what must be equal."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _tables(_BASE, len(data) + 1)
    with np.errstate(over="ignore"):
        run = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=run[1:])
        return mix((run[ends] - run[starts]) * inverse[starts])


def same_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, others: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Whether each span of bytes equals the other one."""
    size = ends - starts
    same = size == other_ends - others
    size = np.where(same, size, 0)
    total = np.cumsum(size)
    cuts = np.unique(np.searchsorted(total, np.arange(0, total[-1] if len(total) else 0, 1 << 18), "right"))
    for s, e in zip(cuts, [*cuts[1:], len(size)]):  # a few bytes at a time
        n = size[s:e]
        first = np.cumsum(n) - n
        at = np.repeat(starts[s:e] - first, n) + np.arange(int(n.sum()))
        unequal = data[at] != data[at + np.repeat(others[s:e] - starts[s:e], n)]
        if unequal.any():
            same[s + np.searchsorted(first, np.flatnonzero(unequal), "right") - 1] = False
    return same


class Words:
    """Words of many texts: starts and ends (bytes), first (the first word of each text, with the end as last), full (their bytes)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.full = full = ~_SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[0] = edge[-1] = True
        edge[offsets] = True
        before, after = edge[:-1].copy(), edge[1:].copy()
        before[1:] |= ~full[:-1]
        after[:-1] |= ~full[1:]
        self.starts, self.ends = np.flatnonzero(full & before), np.flatnonzero(full & after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return hash_spans(self.data, self.starts, self.ends)

    def text_of(self) -> np.ndarray:
        """The text that each word is of."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


class Grams:
    """Hashes of runs of words, from prefix sums over the words' hashes."""

    def __init__(self, hashes: np.ndarray, base: int = _WORD_BASE):
        self.n = len(hashes)
        self.power, self.inverse = _tables(base, self.n + 1)
        with np.errstate(over="ignore"):
            self.run = np.zeros(self.n + 1, np.uint64)
            np.cumsum(hashes * self.power[: self.n], out=self.run[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.run[end] - self.run[start]) * self.inverse[start], seed)


def windows(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all runs of k words within one text, and each text's first run, with the end as last."""
    n = np.maximum(words.counts - k + 1, 0)
    first = np.concatenate([[0], np.cumsum(n)])
    return np.arange(first[-1]) + np.repeat(words.first[:-1] - first[:-1], n), first
