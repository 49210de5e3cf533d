"""Vectorised word hashing over Arrow string buffers.

Texts are hashed as UTF-8 bytes without building Python strings: a
multiplicative prefix sum over the byte buffer gives the 64-bit hash of any
span in constant time, so words, shingles and fixed windows cost a few array
operations per batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MULT = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
#: Bytes hashed at once; longer texts are cut where a word ends.
CHUNK_BYTES = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (xor-shift and multiply rounds)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _byte_values(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93) + U64(seed))


def ascii_lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def class_table(separators: bytes | range | list[int]) -> np.ndarray:
    """True where a byte belongs to a word."""
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


#: Words are runs of anything but the space and the control characters 9 to 13.
SPACE_SEPARATED = class_table([0x20, *range(0x09, 0x0E)])
#: Words are runs of ASCII letters, digits and anything outside ASCII.
ALPHANUMERIC = class_table([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


class SpanHasher:
    """Hashes of spans of one array of bytes, or of words given by their hashes: ``spans(starts, ends)``."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, seed: int = 0):
        mult = (_MULT * (2 * seed + 1) + 4 * seed) & _MASK | 1
        up, down = self._tables(mult, len(data) + 1)
        self._down = down
        self._sum = np.zeros(len(data) + 1, dtype=U64)
        values = _byte_values(seed)[data] if data.dtype == np.uint8 else mix(data + U64((seed * _MULT + 1) & _MASK))
        np.cumsum(values * up[:len(data)], out=self._sum[1:])

    @classmethod
    def _tables(cls, mult: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        have = cls._powers.get(mult)
        if have is None or len(have[0]) < n:
            size = max(n, 1 << 16)
            both = []
            for base in (mult, pow(mult, -1, 1 << 64)):
                steps = np.full(size, base, dtype=U64)
                steps[0] = 1
                both.append(np.multiply.accumulate(steps))
            have = (both[0], both[1])
            if size <= 2 * CHUNK_BYTES:
                cls._powers[mult] = have
        return have

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._sum[ends] - self._sum[starts]) * self._down[starts]
                   + (ends - starts).astype(U64))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (length n + 1, from 0) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a string column, and offsets (length n + 1, from 0) of its rows; nulls are empty."""
    data, offsets = buffers(column)
    counts, (hashes,) = words(data, offsets)
    return hashes, np.concatenate([[0], np.cumsum(counts)])


def row_slices(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``limit`` bytes together; a longer row is a run of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def word_bounds(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of consecutive texts; a word never crosses an offset."""
    inside = is_word[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    finishes = inside.copy()
    finishes[:-1] &= ~inside[1:] | cut[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(finishes) + 1


def _hash_words(data, offsets, is_word, lower, prefix):
    starts, ends = word_bounds(data, offsets, is_word)
    if lower is not None:
        data = lower[data]
    hasher = SpanHasher(data)
    out = [hasher.spans(starts, ends)]
    if prefix:
        out.append(hasher.spans(starts, np.minimum(ends, starts + prefix)))
    counts = np.diff(np.searchsorted(starts, offsets))
    return counts, out


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = SPACE_SEPARATED,
          lower: np.ndarray | None = None, prefix: int = 0) -> tuple[np.ndarray, list[np.ndarray]]:
    """Words per row, and the 64-bit hashes of all words in row order (and of their first ``prefix`` bytes).

    Work is done in runs of rows of ``CHUNK_BYTES``; a longer row is cut at
    ends of words, so memory beyond the result stays bounded.
    """
    counts = np.zeros(len(offsets) - 1, dtype=np.int64)
    parts: list[list[np.ndarray]] = []
    for a, b in row_slices(offsets):
        lo, hi = int(offsets[a]), int(offsets[b])
        if hi - lo <= CHUNK_BYTES:
            n, got = _hash_words(data[lo:hi], offsets[a:b + 1] - lo, is_word, lower, prefix)
            counts[a:b] = n
            parts.append(got)
            continue
        at = lo
        while at < hi:
            end = min(at + CHUNK_BYTES, hi)
            while end < hi and is_word[data[end]] and is_word[data[end - 1]]:
                gap = np.flatnonzero(~is_word[data[end:end + CHUNK_BYTES]])
                end = end + int(gap[0]) if len(gap) else min(end + CHUNK_BYTES, hi)
            n, got = _hash_words(data[at:end], np.array([0, end - at]), is_word, lower, prefix)
            counts[a] += n[0]
            parts.append(got)
            at = end
    width = 2 if prefix else 1
    return counts, [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, U64) for k in range(width)]


def shingles(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of the ``k``-word shingles of one text, ascending; fewer words make one shingle."""
    n = len(word_hashes)
    if n == 0:
        return word_hashes
    k = min(k, n)
    out = word_hashes[:n - k + 1].copy()
    for j in range(1, k):
        out = mix(out * U64(0xC2B2AE3D27D4EB4F) + word_hashes[j:n - k + 1 + j])
    return np.unique(out)
