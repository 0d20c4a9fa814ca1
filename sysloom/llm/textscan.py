"""Helpers inside tasks: words and their hashes straight from Arrow's string buffers.

Texts are never turned into Python strings here; a batch is worked through in groups of
documents of about ``CHUNK`` bytes, so memory does not depend on the size of the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (splitmix64's constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each; a null text is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def groups(offsets: np.ndarray, chunk: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about ``chunk`` bytes together; a longer one stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + chunk, "right")) - 1)
        yield first, last
        first = last


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word (white space separates) and the words before each document."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    filled = offsets[:-1][np.diff(offsets) > 0]
    before[filled] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[filled[1:] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each word."""
    global _powers
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    if (longest := int(lengths.max())) > len(_powers):
        _powers = np.cumprod(np.concatenate([[1], np.full(2 * longest, _BASE, np.uint64)]).astype(np.uint64), dtype=np.uint64)
    at = np.cumsum(lengths) - lengths
    within = np.arange(int(lengths.sum())) - np.repeat(at, lengths)
    values = data[within + np.repeat(starts, lengths)].astype(np.uint64) + np.uint64(1)
    return mix(np.add.reduceat(values * _powers[within], at) ^ lengths.astype(np.uint64))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words (one row for each start that has enough words)."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    n = len(words) - size + 1
    out = words[:n].copy()
    for k in range(1, size):
        out = out * np.uint64(0x100000001B3) + words[k:k + n]
    return mix(out)
