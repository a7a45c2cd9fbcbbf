"""Vectorised word work on Arrow text buffers.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``. UTF-8 never uses those bytes inside a
character, so words of bytes and words of characters are the same. A chunk's words are dictionary
encoded: the codes tell words apart exactly inside the chunk, and each different word is hashed once
with XXH3-128. Hashes of word sequences join those of their halves through a finaliser, so no two
sequences collide by an identity of the hash. Hashes only ever propose: operators that remove or
link text compare real words, by codes or bytes, before they do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from xxhash import xxh3_128_digest

U = np.uint64
CHUNK = 1 << 20
PHI = U(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on a fresh array."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (one more than rows) and bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    elif pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.large_string()), np.int64
    if column.null_count:
        column = column.fill_null("" if "string" in str(column.type) else b"")
    n, at = len(column), column.offset
    parts = column.buffers()
    if n == 0 or parts[1] is None:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(parts[1], kind, n + 1, at * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(parts[2], np.uint8) if parts[2] is not None and parts[2].size else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def values_of(column: pa.Array) -> Iterator[bytes]:
    """The values of a string or binary column, null as empty."""
    offsets, data = buffers(column)
    raw, at = data.tobytes(), offsets.tolist()
    return (raw[s:e] for s, e in zip(at, at[1:], strict=False))


def spans_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Byte ranges, in order and without overlap, as a binary array."""
    n = len(data)
    edge = np.zeros(n + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    inside = np.cumsum(edge[:n], dtype=np.int8).astype(bool)
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    wide = offsets[-1] > 0x7FFFFFFF
    kind, width = (pa.large_binary(), np.int64) if wide else (pa.binary(), np.int32)
    return pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(offsets.astype(width)), pa.py_buffer(data[inside])])


def span_lanes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of byte ranges, equal exactly where the bytes are, and the two 64-bit hash lanes of each code."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros((0, 2), np.uint64)
    coded = spans_of(data, starts, ends).dictionary_encode()
    lanes = np.frombuffer(b"".join(map(xxh3_128_digest, values_of(coded.dictionary))), np.uint64).reshape(-1, 2)
    return coded.indices.to_numpy().astype(np.int64), lanes


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; ranges are in order and do not overlap."""
    codes, lanes = span_lanes(data, starts, ends)
    return lanes[codes, 0]


class Words:
    """Words of some documents: byte ranges, and ``first[i]:first[i+1]`` are those of document i."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, lower: bool = False):
        self.offsets = offsets - offsets[0]
        self.data = LOWER[data] if lower else data
        n = len(data)
        if not n:
            self.starts = self.ends = np.zeros(0, np.int64)
        else:
            solid = ~SPACE[data]
            begins = solid.copy()
            begins[1:] &= ~solid[:-1]
            ends = solid.copy()
            ends[:-1] &= ~solid[1:]
            inner = self.offsets[1:-1]
            inner = inner[(inner > 0) & (inner < n)]
            begins[inner] = solid[inner]
            ends[inner - 1] = solid[inner - 1]
            self.starts = np.flatnonzero(begins)
            self.ends = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self._coded: tuple[np.ndarray, np.ndarray] | None = None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def lanes(self) -> tuple[np.ndarray, np.ndarray]:
        if self._coded is None:
            self._coded = span_lanes(self.data, self.starts, self.ends)
        return self._coded

    def codes(self) -> np.ndarray:
        """Numbers that are equal exactly where words are, within these documents."""
        return self.lanes()[0]

    def hashes(self, lane: int = 0) -> np.ndarray:
        codes, lanes = self.lanes()
        return lanes[codes, lane]

    def canonical(self) -> pa.Array:
        """Each document's words joined by one space."""
        data, gap = self.data, np.ones(len(self.starts), np.int64)
        gap[self.first[1:][self.counts > 0] - 1] = 0  # none after a document's last word
        size = self.ends - self.starts
        at = np.concatenate(([0], np.cumsum(size + gap)))
        out = np.full(int(at[-1]), 32, np.uint8)
        edge = np.zeros(len(out) + 1, np.int8)
        edge[at[:-1]] += 1
        edge[at[:-1] + size] -= 1
        out[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)] = data[~SPACE[data]]
        return pa.Array.from_buffers(pa.large_binary(), len(self.offsets) - 1, [None, pa.py_buffer(at[self.first].astype(np.int64)), pa.py_buffer(out)])


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a + mix(b ^ U(0xD6E8FEB86659FD93)) * PHI)


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive entries of h, as if h were one document; by doubling."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    span, level, out, have = 1, h, None, 0
    while True:
        if k & span:
            part = level[have : have + n]
            out = part if out is None else _pair(out, part)
            have += span
        if span * 2 > k:
            return mix(out)
        level = _pair(level[:-span], level[span:])
        span *= 2


def _number(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers that are equal exactly where the pairs (a, b) are; a and b are below 2**31."""
    return np.unique(a << 32 | b, return_inverse=True)[1].astype(np.int64)


def window_codes(codes: np.ndarray, k: int) -> np.ndarray:
    """Numbers of k consecutive codes that are equal exactly where the sequences are; by doubling."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    span, level, out, have = 1, codes, None, 0
    while True:
        if k & span:
            part = level[have : have + n]
            out = part if out is None else _number(out, part)
            have += span
        if span * 2 > k:
            return out
        level = _number(level[:-span], level[span:])
        span *= 2


def _shingles(words: Words, k: int, flat: np.ndarray, window, short) -> tuple[np.ndarray, np.ndarray]:
    counts = words.counts
    whole = window(flat, k)
    n_out = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    first = np.concatenate(([0], np.cumsum(n_out)))
    doc = np.repeat(np.arange(len(counts)), n_out)
    at = words.first[:-1][doc] + (np.arange(first[-1]) - first[:-1][doc])
    out = np.zeros(first[-1], flat.dtype)
    full = counts[doc] >= k
    out[full] = whole[at[full]]
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        out[first[i]] = short(flat[words.first[i] : words.first[i + 1]])
    return out, first


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles of each document, repeated ones too, and where each document's begin.

    A document of fewer words has its whole sequence as one shingle; one without words has none.
    """
    return _shingles(words, k, words.hashes(), window_hashes, lambda h: window_hashes(h, len(h))[0] ^ U(len(h) * int(PHI) & (1 << 64) - 1))


def shingle_codes(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``shingles`` with numbers that are equal exactly where the word sequences are, within these documents."""
    seen: dict[bytes, int] = {}
    return _shingles(words, k, words.codes(), window_codes, lambda c: -1 - seen.setdefault(c.tobytes(), len(seen)))


def distinct_sorted(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each document's part of h."""
    parts, sizes = [], np.zeros(len(first) - 1, np.int64)
    for i in range(len(first) - 1):
        part = np.sort(h[first[i] : first[i + 1]])
        if len(part) > 1:
            part = part[np.concatenate(([True], part[1:] != part[:-1]))]
        parts.append(part)
        sizes[i] = len(part)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return flat, np.concatenate(([0], np.cumsum(sizes)))


def segment_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each document's part, modulo 2**64 for unsigned values."""
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def range_hashes(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of h[s:e] for each given range of one entry or more, which may overlap; the length counts too."""
    size = ends - starts
    depth = np.frexp(size)[1] - 1  # two windows of 2**depth entries cover a range
    out, level, span = np.zeros(len(starts), np.uint64), h, 1
    for d in range(int(depth.max()) + 1 if len(depth) else 0):
        here = np.flatnonzero(depth == d)
        out[here] = _pair(level[starts[here]] + size[here].astype(np.uint64) * PHI, level[ends[here] - span])
        if len(level) <= span:
            break
        level = _pair(level[:-span], level[span:])
        span *= 2
    return out


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive entries, by doubling."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    span, cur = 1, x
    while span * 2 <= w:
        cur = np.minimum(cur[:-span], cur[span:])
        span *= 2
    if span < w:
        cur = np.minimum(cur[:n], cur[w - span : w - span + n])
    return cur[:n]
