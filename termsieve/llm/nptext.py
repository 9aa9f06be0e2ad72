"""Vectorised text kernels over Arrow buffers: words, lines and n-gram hashes without Python strings.

A chunk is a run of whole documents of about CHUNK bytes (one longer document is a chunk of its
own), so memory follows the longest document, never the partition. Substrings are hashed with
prefix polynomials modulo 2**64: with H[i] = sum((b[j] + 1) * B**j, j < i), the substring [s, e)
has the value (H[e] - H[s]) * B**-s, whatever its place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept for ordinary chunk sizes."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK + 1), base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 2 * CHUNK:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (prefix[end] - prefix[start]) * powers(INVERSE, len(prefix))[start]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n+1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    if off is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    o = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    d = np.frombuffer(data, dtype=np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return d, o - o[0]


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole rows."""
    data, off = buffers(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, side="right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


class Chunk:
    """Words and their hashes of some whole documents. white: which bytes are no part of a word."""

    def __init__(self, data: np.ndarray, off: np.ndarray, lower: bool = False, white: np.ndarray = WHITE):
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        self.data, self.off, self.n = data, off, len(off) - 1
        black = np.zeros(len(data) + 2, dtype=bool)
        black[1:-1] = ~white[data]
        self.black = black[1:-1]
        begins, ends = black[1:-1] & ~black[:-2], black[1:-1] & ~black[2:]
        first = off[:-1][off[:-1] < off[1:]]
        begins[first] = self.black[first]
        last = off[1:][off[:-1] < off[1:]] - 1
        ends[last] = self.black[last]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        #: Index of the first word of each document, and of the end of the last.
        self.word_off = np.searchsorted(self.start, off)
        self.n_words = np.diff(self.word_off)
        self.word_doc = np.repeat(np.arange(self.n), self.n_words)
        self.prefix = prefix_hash(data)

    def per_doc(self, mask: np.ndarray) -> np.ndarray:
        """True bytes of the mask in each document."""
        c = np.zeros(len(mask) + 1, dtype=np.int64)
        np.cumsum(mask, out=c[1:])
        return c[self.off[1:]] - c[self.off[:-1]]

    def words(self) -> np.ndarray:
        return mix(span_hash(self.prefix, self.start, self.end) + (self.end - self.start).astype(np.uint64))

    def word_grams(self, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word of every n-gram of words within a document."""
        if len(h) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        g = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            g = g * np.uint64(0x9FB21C651E98DF25) + h[k : len(h) - n + 1 + k]
        at = np.flatnonzero(self.word_doc[: len(g)] == self.word_doc[n - 1 :])
        return mix(g[at]), at

    def shapes(self, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word of every n-gram of words of which some are equal: its shape (a b a c), whatever the words."""
        if len(h) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        m = len(h) - n + 1
        code, plain = np.zeros(m, dtype=np.uint64), 0
        for i in range(n):
            first = np.full(m, i, dtype=np.uint64)
            for j in range(i - 1, -1, -1):
                first[h[j : j + m] == h[i : i + m]] = j
            code = code * np.uint64(n) + first
            plain = plain * n + i
        at = np.flatnonzero((self.word_doc[:m] == self.word_doc[n - 1 :]) & (code != np.uint64(plain)))
        return mix(code[at] + np.uint64(n)), at

    def byte_grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and document of every n-gram of bytes within a document."""
        if len(self.data) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        doc = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(self.off))
        m = len(self.data) - n + 1
        h = (self.prefix[n:] - self.prefix[:m]) * powers(INVERSE, len(self.prefix))[:m]
        at = np.flatnonzero(doc[:m] == doc[n - 1 :])
        return mix(h[at]), doc[at]

    def char_grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and document of every n-gram of code points within a document."""
        lead = np.flatnonzero((self.data & 0xC0) != 0x80)
        m = len(lead) - n + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        doc = np.searchsorted(self.off, lead, side="right") - 1
        at = np.flatnonzero(doc[:m] == doc[n - 1 :])
        start, end = lead[at], np.append(lead, len(self.data))[at + n]
        return mix(span_hash(self.prefix, start, end) + (end - start).astype(np.uint64)), doc[at]


def repeats(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element: whether its key occurs twice or more, and whether it occurred before."""
    if not len(key):
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = np.zeros(len(k) + 1, dtype=bool)
    same[1:-1] = k[1:] == k[:-1]
    twice, before = np.empty(len(k), bool), np.empty(len(k), bool)
    twice[order] = same[1:] | same[:-1]
    before[order] = same[:-1]
    return twice, before
