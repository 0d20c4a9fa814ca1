"""Whitening of embeddings by shifted CholeskyQR.

Rows are centred exactly (integer components against integer sums) and orthogonalised by
repeated passes: each pass adds up the Gram matrix of the rows after triangular solves with
the factors found so far, and the driver factors that small matrix.  The first factor is
taken of a shifted Gram matrix, so nearly dependent dimensions do not break it; passes go on
until the Gram matrix is the identity to rounding.  The factors compose to the R of a QR
decomposition of all rows, whose singular values and right vectors give the components.

Each pass reads the written rows, adds up within its tasks and sends a row per matrix
element and task into a grouped sum; ``dimensions`` squared numbers reach the driver.

Rows: vectors that are null or hold null or non-finite entries are left out.  The dimension
is the most frequent length (ties: the longer); vectors of another length, or without entries,
are left out as well.  Repeated rows and equal vectors count each, a null id is a row like any
other.  Directions without variance have no component, so there may be fewer than asked for;
equal vectors, a single row or an empty table give an empty result.  A deviation that passes
64 bits is null; sums that pass them raise an error.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .lloyd import finite

COMPONENTS = 8
SCALE, OFFSET = 1024, 100_000
#: Entries of a vector; the Gram matrix at the driver has their square.
MAX_DIMENSIONS = 4096
MAX_PASSES = 6
#: Largest entry of the Gram matrix beside the identity at which the rows count as orthonormal.
ORTHONORMAL = 1e-13
#: Share of the largest singular value below which a direction has no variance.
FLAT = 1e-10
_UNIT = float(np.finfo(float).eps) / 2


def _rows(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _solved(x: np.ndarray, n: int, sums: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """Centred rows behind the triangular solves with all factors so far."""
    rows = (n * x - sums) / n
    for r in factors:
        for j in range(rows.shape[1]):
            rows[:, j] = (rows[:, j] - rows[:, :j] @ r[:j, j]) / r[j, j]
    return rows


def gram(table: DataFrame, width: int, rows_of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of the outer products of what ``rows_of`` makes of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            y = rows_of(_rows(batch, width))
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "value"])

    found = table.select("x").mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
    size = max((r.j for r in found), default=-1) + 1
    out = np.zeros((size, size))
    for r in found:
        out[r.i, r.j] = out[r.j, r.i] = r.value
    return out


def _factor(g: np.ndarray, n: int, first: bool) -> np.ndarray:
    """Upper triangular factor of a Gram matrix, shifted where it must be."""
    d = len(g)
    shift = 11 * (n * d + d * (d + 1)) * _UNIT * max(np.linalg.norm(g, 2), np.finfo(float).tiny)
    if not first:
        try:
            return np.linalg.cholesky(g).T
        except np.linalg.LinAlgError:
            pass
    return np.linalg.cholesky(g + min(shift, np.trace(g) * 1e-3) * np.eye(d)).T


def components(table: DataFrame, n: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All eigenvalues of the covariance, falling, and the unit eigenvectors as rows."""
    width, factors = len(sums), []
    while True:
        g = gram(table, width, lambda x, f=tuple(factors): _solved(x, n, sums, list(f)))
        if not factors and not np.trace(g) > 0:
            return np.zeros(width), np.eye(width)
        if factors and (np.abs(g - np.eye(width)).max() <= ORTHONORMAL * width or len(factors) >= MAX_PASSES):
            break
        factors.append(_factor(g, n, not factors))
    # the root of the last Gram matrix, the identity unless directions lack variance
    values, vectors = np.linalg.eigh(g)
    r = (np.sqrt(np.maximum(values, 0))[:, None] * vectors.T)
    for factor in reversed(factors):
        r = r @ factor
    _, singular, right = np.linalg.svd(r)
    return singular ** 2 / n, right


def whiten(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", keep: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET,
) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component up to ``keep``."""
    vector = F.col(vector_col)
    kind = table.schema[id_col].dataType.simpleString()
    integers = F.transform(vector, lambda c: (F.floor(c.cast("double") * scale) + offset).cast("long"))
    rows = cut_lineage(table.filter(finite(vector) & (F.size(vector) > 0)).select(F.col(id_col).alias("id"), integers.alias("x")))
    lengths = sorted(rows.groupBy(F.size("x").alias("width")).count().collect(), key=lambda r: (r["count"], r.width))
    schema = f"{{}} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    empty = table.sparkSession.createDataFrame([], schema.format(id_col))
    if not lengths:
        return empty
    width, n = lengths[-1].width, lengths[-1]["count"]
    if width > MAX_DIMENSIONS:
        raise ValueError(f"vectors have more than {MAX_DIMENSIONS} entries")
    same = rows.filter(F.size("x") == width)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, ends = np.zeros(width, np.int64), np.zeros((2, width), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch, width)
                total += x.sum(axis=0)
                ends = np.stack([np.minimum(ends[0], x.min(axis=0)), np.maximum(ends[1], x.max(axis=0))])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(total), pa.array(np.abs(ends).max(axis=0))], ["i", "total", "most"])

    found = same.select("x").mapInArrow(add, "i int, total long, most long").groupBy("i").agg(F.sum("total").alias("s"), F.max("most").alias("most")).collect()
    sums, most = np.zeros(width, np.int64), max(r.most for r in found)
    for r in found:
        sums[r.i] = r.s
    if n * most >= 1 << 62:
        raise ValueError("sums of the components pass 64 bits")
    values, vectors = components(same, n, sums)
    used = [k for k in range(min(keep, width)) if values[k] > values[0] * FLAT ** 2 and values[k] > 0]
    if not used:
        return empty
    project = vectors[used].T / np.sqrt(values[used])
    explained = values / values.sum()

    covariance = gram(same, width, lambda x: ((n * x - sums) / n) @ project) / n
    error = float(np.abs(covariance - np.eye(len(used))).max())

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            away = n * _rows(batch, width) - sums
            # checked in floating point, as the exact sum would wrap
            beyond = (away.astype(float) ** 2).sum(axis=1) >= 2.0 ** 63 * (1 - 1e-9)
            white, m = (away / n) @ project, len(used)
            yield pa.RecordBatch.from_arrays([
                batch.column("id").take(pa.array(np.repeat(np.arange(len(away)), m))), pa.array(np.tile(np.array(used) + 1, len(away)), pa.int32()),
                pa.array(np.full(len(away) * m, n)), pa.array(np.repeat((away * away).sum(axis=1), m), mask=np.repeat(beyond, m)), pa.array(white.ravel()),
                pa.array(np.tile(explained[used], len(away))), pa.array(np.full(len(away) * m, error))],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return same.mapInArrow(transform, schema.format("id")).withColumnRenamed("id", id_col)
