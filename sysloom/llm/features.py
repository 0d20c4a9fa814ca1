"""Hashed word n-grams and skip-grams of whole texts, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
#: ASCII characters that are neither letter nor digit separate words, as white space does.
_LOWER[[b for b in range(128) if not chr(b).isalnum()]] = 32
#: Bytes at the start of a word that stand for its stem.
STEMS = (4, 5)


def keyed(labelled: DataFrame) -> DataFrame:
    """(key, label, text): the key tells documents with equal texts apart where they have a doc_id."""
    return labelled.select(F.xxhash64(*[c for c in ("doc_id", "text") if c in labelled.columns]).alias("key"), "label", "text")


def gram_hashes(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of each word, word start, bigram and one-word skip-gram.

    Words are runs of letters and digits, lower case in ASCII; other scripts' letters are
    taken as they are.
    """
    data = _LOWER[data]
    starts, ends, before = textscan.word_bounds(data, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    words = textscan.word_hashes(data, starts, ends)
    docs, out = [doc], [words]
    for size in STEMS:
        long = ends - starts > size
        docs.append(doc[long])
        out.append(textscan.mix(textscan.word_hashes(data, starts[long], starts[long] + size) + np.uint64(size)))
    for gap in (1, 2):
        same = doc[:-gap] == doc[gap:]
        docs.append(doc[:-gap][same])
        out.append(textscan.mix(words[:-gap] * np.uint64(0x9E3779B97F4A7C15) + words[gap:] + np.uint64(gap))[same])
    return np.concatenate(docs), (np.concatenate(out) >> np.uint64(64 - bits)).astype(np.int64)


def per_group(column: pa.Array, bits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For groups of documents: first and last row, and (document, bucket) of their features."""
    data, offsets = textscan.utf8(column)
    for a, b in textscan.groups(offsets):
        part = offsets[a:b + 1]
        yield a, b, *gram_hashes(data[part[0]:part[-1]], part - part[0], bits)
