"""Vectorised text primitives shared by the corpus operators.

Texts arrive as Arrow string columns; everything here works on the column's own UTF-8 buffer with numpy, in slices of
about a megabyte, so that a batch of thousands of documents needs a few array passes and bounded temporaries. Hashes
are polynomial over random 64-bit byte codes (prefix sums make every substring hash O(1)), finished with a mixer. All
tables come from fixed seeds, so that every executor and every retry computes the same values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 20

_MULT = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1)
_rng = np.random.Generator(np.random.PCG64(20240607))
_CODES = tuple(_rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1) for _ in range(2))
_WORD_MULT = U64(0xC2B2AE3D27D4EB4F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _ascii_lower() -> np.ndarray:
    t = np.arange(256)
    t[65:91] += 32
    return t


#: Byte codes after lower-casing A-Z only.
LOWER_CODES = _CODES[0][_ascii_lower()]

#: Words of any bytes but white space x20, x09-x0D.
SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[0x20, *range(0x09, 0x0E)]] = False
#: Words of ASCII letters and digits and of all non-ASCII characters (whose UTF-8 bytes are all over x7F).
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[0x30:0x3A] = ALNUM_WORDS[0x41:0x5B] = ALNUM_WORDS[0x61:0x7B] = ALNUM_WORDS[0x80:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3 (a bijection)."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse, modulo 2**64."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = 1 << max(18, int(n - 1).bit_length())
        inverse = pow(_MULT[which], -1, 1 << 64)
        tables = []
        for base in (_MULT[which], inverse):
            t = np.full(size, U64(base), U64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        have = _powers[which] = (tables[0], tables[1])
    return have[0][:n], have[1][:n]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    body = column.buffers()[2] if n else None
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    starts, ends = offsets[:-1].copy(), offsets[1:].copy()
    if column.null_count:
        null = ~np.asarray(column.is_valid())
        ends[null] = starts[null]
    return data, starts, ends


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, starts, ends) of runs of rows of about `most` bytes; a longer text is a run alone."""
    data, starts, ends = text_buffers(column)
    i, n = 0, len(starts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + most, side="right")))
        j = min(j, n)
        base = starts[i]
        yield i, j, data[base : max(base, ends[j - 1])], starts[i:j] - base, ends[i:j] - base
        i = j


def prefix(data: np.ndarray, codes: np.ndarray, which: int = 0) -> np.ndarray:
    """Prefix sums of the polynomial hash: [0, c0, c0+c1 m, ...]."""
    p, _ = powers(len(data) + 1, which)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(codes[data] * p[: len(data)], out=out[1:])
    return out


def spans_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of the substrings [start, end); equal strings give equal hashes wherever they stand."""
    _, inverse = powers(len(pre), which)
    return (pre[end] - pre[start]) * inverse[start]


class Words:
    """The words of a run of texts: start, end, hash (ASCII lower case) and text index of each, and each text's first."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: np.ndarray) -> None:
        n = len(data)
        full = ends > starts
        inside = kind[data] if n else np.zeros(0, bool)
        first, last = inside.copy(), inside.copy()
        if n:
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            at = starts[full]
            first[at] = inside[at]
            at = ends[full] - 1
            last[at] = inside[at]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.text = np.searchsorted(ends, self.start, side="right")
        self.count = np.bincount(self.text, minlength=len(starts)).astype(np.int64)
        self.ptr = np.concatenate(([0], np.cumsum(self.count)))
        pre = prefix(data, LOWER_CODES)
        self.hash = mix(spans_hash(pre, self.start, self.end) + (self.end - self.start).astype(U64))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every run of k words that stays within a text."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        g = np.zeros(n, U64)
        for j in range(k):
            g = g * _WORD_MULT + self.hash[j : j + n]
        at = np.flatnonzero(self.text[:n] == self.text[k - 1 :])
        return at, mix(g[at] + U64(k))


def sequence_hash(hashes: np.ndarray) -> int:
    """As Words.grams() gives for the whole sequence."""
    g = U64(0)
    with np.errstate(over="ignore"):
        for h in hashes:
            g = g * _WORD_MULT + h
        return int(mix(np.array([g + U64(len(hashes))], U64))[0])


def window_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by doubling."""
    out, have = values, 1
    while 2 * have <= w:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    if have < w:
        rest = w - have
        out = np.minimum(out[: len(out) - rest], out[rest:])
    return out


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def ragged(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, joined."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts)
