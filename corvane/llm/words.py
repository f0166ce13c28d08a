"""Vectorised words, hashes and word shingles of a batch of texts, for tasks that work on Arrow batches.

A slice of a batch is one byte array with document offsets; every function works on whole slices, and slices are cut
to about SLICE_BYTES (a longer text is a slice of its own), so memory follows the slice and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
_BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES * 2), base, dtype=np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes of words: ASCII letters (lower-cased) and digits, and every byte of a non-ASCII character; 0 separates.
PLAIN = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 0 for c in range(256)], dtype=np.uint8)
#: Bytes of words: all but the white space 0x20 and 0x09 to 0x0D.
NON_SPACE = np.array([0 if c == 32 or 9 <= c <= 13 else max(c, 1) for c in range(256)], dtype=np.uint8)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the documents in them) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if column.null_count:  # a null may still own bytes
        lengths = np.diff(at)
        lengths[~np.asarray(column.is_valid())] = 0
        if lengths.sum() != at[-1] - at[0]:
            yield from slices(column.fill_null(b""), limit)
            return
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield first, last, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span; equal bytes have equal hashes wherever they stand."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[values] * _power(_BASE, len(values)), out=total[1:])
    return mix((total[ends] - total[starts]) * _power(_BASE_INV, len(values) + 1)[starts] + (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(mapped bytes, starts, ends, first word of each document and the total) of the words in a slice."""
    mapped = table[data]
    inside = mapped != 0
    edge = np.zeros(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return mapped, starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = PLAIN) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, first word of each document and the total) of a slice."""
    mapped, starts, ends, first = word_spans(data, offsets, table)
    return span_hashes(mapped, starts, ends), first


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words from each word on, over the whole slice; those that cross a document's end mean nothing."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        out = out * np.uint64(_BASE) + words[j : len(words) - n + 1 + j]
    return mix(out + np.uint64(n))


def shingles(words: np.ndarray, first: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first shingle of each document and the total). A text of 1 to n - 1 words has one shingle, of all its words."""
    count = np.diff(first)
    each = np.where(count >= n, count - n + 1, (count > 0).astype(count.dtype))
    at = np.concatenate([[0], np.cumsum(each)])
    out = np.zeros(at[-1], np.uint64)
    g = grams(words, n)
    full = np.flatnonzero(count >= n)
    if len(full):
        index = np.arange(each[full].sum()) + np.repeat(first[:-1][full] - np.concatenate([[0], np.cumsum(each[full])[:-1]]), each[full])
        place = np.arange(each[full].sum()) + np.repeat(at[:-1][full] - np.concatenate([[0], np.cumsum(each[full])[:-1]]), each[full])
        out[place] = g[index]
    for d in np.flatnonzero((count > 0) & (count < n)):
        out[at[d]] = grams(words[first[d] : first[d + 1]], int(count[d]))[0]
    return out, at
