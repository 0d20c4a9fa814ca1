"""Document fingerprints: threshold-scaled sketches of shingle hashes.

A sketch keeps every hash of a text's byte shingles below a fixed fraction of the hash range,
so its size grows with the text and two sketches compare at one threshold however unequal
the texts are.  The fraction is the same for all texts: a kilobyte keeps about 64 hashes, five
bytes each, and an estimate from them is off by about 0.06.  A sketch carries its threshold, and
sketches merge by union at the smaller one.  Likeness is the estimated containment of a text's
shingles in another text.

Rows: a null text is empty.  An empty text has an empty sketch, and a short one may have, since
the fraction holds for it as well; two empty sketches are alike (1), one is unlike any other (0).
Texts shorter than a shingle have one shingle; very long ones are worked through in slices.  The next
document goes by ascending id, null ids last, rows of equal ids by text; the one after the last
is the first.  Ids may be of any type that has an order.  A single row follows itself, an empty table gives an empty result.  Other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..operators.numbering import number_rows
from ..session import cut_lineage
from .textscan import mix

SHINGLE_BYTES = 12
FRACTION = 1 / 16
BITS = 40
ALL = (1 << BITS) - 1
Sketch = tuple[int, np.ndarray]  # threshold, ascending hashes up to it
_SLICE = 1 << 20


def shingle_hashes(text: bytes) -> np.ndarray:
    """Hash of each run of ``SHINGLE_BYTES`` bytes (of the whole text if it is shorter)."""
    if not text:
        return np.zeros(0, np.uint64)
    text = text.ljust(SHINGLE_BYTES, b"\0")
    eight = np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))
    rest = SHINGLE_BYTES - 8
    return mix(eight[:-rest] + mix(eight[rest:])) >> np.uint64(64 - BITS)


def sketch(text: bytes, fraction: float = FRACTION) -> Sketch:
    limit = int(fraction * ALL)
    parts = [shingle_hashes(text[k:k + _SLICE + SHINGLE_BYTES - 1]) for k in range(0, max(1, len(text) - SHINGLE_BYTES + 1), _SLICE)]
    return limit, np.unique(np.concatenate([h[h <= limit] for h in parts]))


def merge(a: Sketch, b: Sketch) -> Sketch:
    """Sketch of the union of two texts' shingles."""
    limit = min(a[0], b[0])
    both = np.union1d(a[1], b[1])
    return limit, both[both <= limit]


def likeness(a: Sketch, b: Sketch) -> float:
    """Estimated share of the first text's shingles that the second holds."""
    limit = min(a[0], b[0])
    x, y = a[1][a[1] <= limit], b[1][b[1] <= limit]
    if not len(x):
        return float(not len(a[1]) and not len(b[1]))
    return len(np.intersect1d(x, y, assume_unique=True)) / len(x)


def to_string(s: Sketch) -> str:
    """Threshold and hashes, ten hexadecimal digits each."""
    return np.append(np.uint64(s[0]), s[1]).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BITS // 8:].tobytes().hex()


def from_string(text: str) -> Sketch:
    digits = BITS // 4
    values = [int(text[k:k + digits], 16) for k in range(0, len(text), digits)]
    return values[0], np.array(values[1:], np.uint64)


def _in_order(docs: DataFrame) -> DataFrame:
    """(bucket, copy, id, text): ranges of ids, each closed by a copy of what follows it.

    Bucket borders are quantiles of the ids.  A few hundred borders per thousand partitions
    reach the driver, and as many rows, one per bucket, are broadcast back.
    """
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    inner = [k / buckets for k in range(1, buckets)]
    borders = sorted(set(docs.select(F.col("id").cast("double")).na.drop().approxQuantile("id", inner, 0.25 / buckets)))
    border = F.array(*map(F.lit, borders)).cast("array<double>")
    bucket = F.when(F.col("id").isNull(), len(borders) + 1).otherwise(F.size(F.filter(border, lambda b: b <= F.col("id"))))
    firsts = docs.select("id", bucket.alias("bucket")).groupBy("bucket").agg(F.min("id").alias("id")).orderBy("bucket").collect()
    rows = docs.select(bucket.alias("bucket"), F.lit(False).alias("copy"), "id", "text")
    if firsts:
        to = [(r.id, firsts[k - 1].bucket) for k, r in enumerate(firsts)]
        target = spark.createDataFrame(to, "first_id long, to int")
        copies = rows.join(F.broadcast(target), F.col("id").eqNullSafe(F.col("first_id")))
        rows = rows.unionByName(copies.select(F.col("to").alias("bucket"), F.lit(True).alias("copy"), "id", "text"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(partitions, "bucket").sortWithinPartitions("bucket", "copy", F.col("id").asc_nulls_last(), "text")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of each whole text."""
    @F.pandas_udf("string")
    def made(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: to_string(sketch((t or "").encode())))

    return docs.select(id_col, made(text_col).alias("fingerprint"))


def against_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited form, whose second half is taken from the
    next document's start, and how alike they and the next document are."""
    kind = docs.schema[id_col].dataType
    named = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    if isinstance(kind, IntegralType):
        return _compared(named.withColumn("id", F.col("id").cast("long"))).withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)
    # other ids are numbered in their order
    numbers = cut_lineage(number_rows(named.select("id").na.drop().distinct(), [], ["id"]).select(F.col("row_no").cast("long").alias("number"), "id"))
    found = _compared(named.join(numbers, "id", "left").select(F.col("number").alias("id"), "text")).withColumnRenamed("id", "number")
    return found.join(numbers, "number", "left").drop("number").select(F.col("id").alias(id_col), *found.columns[1:])


def _compared(named: DataFrame) -> DataFrame:
    def row(doc, text: str, own: Sketch, after: str, following: Sketch) -> tuple:
        half = len(text) // 2
        edited = (text[:len(text) - half] + after[:half]).encode()
        changed = sketch(edited)
        return (doc, len(text), hashlib.sha256(edited).hexdigest(), to_string(own), to_string(changed), likeness(own, changed), likeness(own, following))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row that waits for its successor
        for batch in batches:
            rows = []
            for bucket, copy, doc, text in zip(*batch.columns):
                bucket, copy, text = bucket.as_py(), copy.as_py(), text.as_py()
                own = sketch(text.encode())
                if last and last[0] == bucket and not last[1]:
                    rows.append(row(*last[2:], text, own))
                last = (bucket, copy, doc.as_py(), text, own)
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _in_order(named).mapInArrow(run, schema)
