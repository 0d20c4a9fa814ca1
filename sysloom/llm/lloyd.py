"""Dimension-sharded Lloyd clustering in exact integers.

Vectors are written once with one column per block of dimensions, so a block's tasks read
their own columns only.  In a round the tasks of each block hold the centroid slice of that
block and send, per vector, its partial squared distances to all centroids.  One shuffle by
vector adds the blocks and takes the nearest centroid; each task then adds up the vectors of
every cluster, and the sums of a dimension meet in the group that updates its slice.  All of
it is integer arithmetic, so results do not depend on the order of rows or tasks.

What reaches the driver is the model, ``clusters`` times ``dimensions`` numbers, at most
``MAX_MODEL``.  A round reads the written table afresh: its plan does not grow, and what an
executor loses is computed again from the table.

Rows: vectors that are null, have another number of components, or hold null or non-finite
ones are left out.  Repeated rows and equal vectors are vectors of their own; a null id is
assigned like any other but is never a first centroid.  With fewer ids than clusters there are
fewer centroids, without any (or on an empty table) the result is empty.  Components so large
that a squared distance passes 64 bits raise an error instead of a wrong result.  Other columns
are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, release

#: Dimensions of one block.
BLOCK = 16
#: Numbers of the model, which the driver holds and every task of a block gets its part of.
MAX_MODEL = 1 << 24


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are numbers."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & whole


def _flat(lists: pa.Array, width: int) -> np.ndarray:
    """Lists of ``width`` numbers each as rows of a matrix."""
    values = lists.flatten()
    while pa.types.is_list(values.type):
        values = values.flatten()
    return values.to_numpy(zero_copy_only=False).reshape(-1, width)


def _matrix_lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel(), kind))


def partial_distances(block: int, centres: np.ndarray, kind: pa.DataType) -> Callable:
    """Messages [block, partial distance to each centroid, components] of one block's vectors."""
    k, width = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _flat(batch.column("x"), width).astype(np.int64)
            message = np.zeros((len(x), 1 + k + width), np.int64)
            message[:, 0], message[:, 1 + k:] = block, x
            for j in range(width):
                away = x[:, j, None] - centres[None, :, j]
                message[:, 1:1 + k] += away * away
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), _matrix_lists(message, kind)], ["row", "id", "message"])

    return run


def _nearest(messages: pa.Array, blocks: int, width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the smaller number), squared distance and components of each vector."""
    length = 1 + k + width
    parts = _flat(messages, blocks * length).reshape(-1, blocks, length).astype(np.int64)
    parts = np.take_along_axis(parts, np.argsort(parts[:, :, 0], axis=1)[:, :, None], axis=1)
    distances = parts[:, :, 1:1 + k].sum(axis=1)
    cluster = distances.argmin(axis=1)
    return cluster, distances[np.arange(len(cluster)), cluster], parts[:, :, 1 + k:].reshape(len(cluster), blocks * width)


def cluster_sums(blocks: int, width: int, k: int) -> Callable:
    """(dimension, cluster, total, n): what the vectors of a task add to each cluster."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = np.zeros((k, blocks * width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            cluster, _, x = _nearest(batch.column("messages"), blocks, width, k)
            order = np.argsort(cluster, kind="stable")
            found, first = np.unique(cluster[order], return_index=True)
            totals[found] += np.add.reduceat(x[order], first, axis=0)
            counts += np.bincount(cluster, minlength=k)
        held = np.flatnonzero(counts)
        cluster = np.repeat(held, blocks * width)
        dimension = np.tile(np.arange(blocks * width), len(held))
        yield pa.RecordBatch.from_arrays(
            [pa.array(dimension, pa.int32()), pa.array(cluster, pa.int32()), pa.array(totals[held].ravel()), pa.array(counts[cluster])],
            ["dimension", "cluster", "total", "n"])

    return run


def assignments(blocks: int, width: int, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance, _ = _nearest(batch.column("messages"), blocks, width, k) if batch.num_rows else (np.zeros(0),) * 3
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["id", "cluster", "distance"])

    return run


def _messages(vectors: DataFrame, centres: np.ndarray, blocks: int, kind: str) -> DataFrame:
    """The messages of all blocks, gathered per vector."""
    width = centres.shape[1] // blocks
    arrow = pa.int32() if kind == "int" else pa.int64()
    schema = f"row long, id {vectors.schema['id'].dataType.simpleString()}, message array<{kind}>"
    sent = [vectors.select("row", "id", F.col(f"b{b}").alias("x")).mapInArrow(
        partial_distances(b, centres[:, b * width:(b + 1) * width], arrow), schema) for b in range(blocks)]
    return reduce(DataFrame.unionAll, sent).groupBy("row", "id").agg(F.collect_list("message").alias("messages"))


def cluster(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = 64, clusters: int = 40, rounds: int = 5,
    scale: int = 256, salt: str = "2", block: int = BLOCK,
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that is kept.

    Components become ``floor(scale * x)``.  The first centroids are the vectors with the
    smallest SHA-256 of ``salt:id``; centroids are replaced by exact floored means.
    """
    if clusters < 1 or clusters * dimensions > MAX_MODEL:
        raise ValueError(f"clusters times dimensions must be between 1 and {MAX_MODEL}")
    block = min(block, dimensions)
    blocks = -(-dimensions // block)
    vector = F.col(vector_col)
    kept = table.filter(finite(vector) & (F.size(vector) == dimensions)).select(
        F.col(id_col).alias("id"), F.transform(vector, lambda x: x.cast("double") * scale).alias("scaled"))
    # beyond this a sum of squared differences would not fit into 64 bits
    limit = int((((1 << 62) / dimensions) ** 0.5) / 2)
    too_large = F.exists("scaled", lambda x: F.abs(x) > limit)
    checked = F.when(too_large, F.raise_error(F.lit(f"a scaled component is beyond {limit}")).cast("array<bigint>"))
    kept = kept.select("id", checked.otherwise(F.transform("scaled", lambda x: F.floor(x))).alias("x"))
    padded = F.concat("x", F.array_repeat(F.lit(0).cast("long"), blocks * block - dimensions)) if blocks * block > dimensions else F.col("x")
    vectors = cut_lineage(kept.select(F.monotonically_increasing_id().alias("row"), "id", padded.alias("x")).select(
        "row", "id", *[F.slice("x", b * block + 1, block).alias(f"b{b}") for b in range(blocks)]))

    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    whole = F.concat(*[f"b{b}" for b in range(blocks)])
    # a repeated id: the smaller vector first
    seeds = vectors.filter("id is not null").select(digest.alias("h"), whole.alias("x")).orderBy("h", "x").limit(clusters).collect()
    schema = f"{{}} {table.schema[id_col].dataType.simpleString()}, cluster int, distance long"
    if not seeds:
        release(vectors)
        empty = table.sparkSession.createDataFrame([], schema.format(id_col) + ", cluster_inertia long, inertia long, centroid_sha256 string")
        return empty
    centres = np.array([r.x for r in seeds], np.int64)
    k = len(centres)
    widest = vectors.agg(*[F.max(F.expr(f"greatest(array_max(b{b}), -array_min(b{b}))")).alias(f"m{b}") for b in range(blocks)]).first()
    kind = "int" if 4 * block * max(widest) ** 2 < 1 << 31 else "long"

    for _ in range(rounds):
        sums = _messages(vectors, centres, blocks, kind).select("messages").mapInArrow(
            cluster_sums(blocks, block, k), "dimension int, cluster int, total long, n long")
        slices = sums.groupBy("dimension", "cluster").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        for r in slices.selectExpr("dimension", "cluster", "(total - pmod(total, n)) div n AS mean").collect():
            centres[r.cluster, r.dimension] = r.mean

    found = cut_lineage(_messages(vectors, centres, blocks, kind).drop("row").mapInArrow(assignments(blocks, block, k), schema.format("id")))
    release(vectors)
    inertia = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    total = sum(inertia.values())
    digests = [hashlib.sha256(",".join(map(str, c[:dimensions])).encode()).hexdigest() for c in centres.tolist()]
    model = table.sparkSession.createDataFrame(
        [(c, s, total, digests[c]) for c, s in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # a row per cluster
    return found.join(F.broadcast(model), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(dimensions: int = 64, clusters: int = 40, rounds: int = 5, scale: int = 256) -> str:
    steps = [f"""
kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = {dimensions}
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
dims AS MATERIALIZED (SELECT r, unnest(range({dimensions})) AS j, unnest(v) AS x FROM kept),
seeds AS (SELECT r, row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c FROM kept WHERE vec_id IS NOT NULL
  ORDER BY c LIMIT {clusters}),
m0 AS MATERIALIZED (SELECT c, j, x AS m FROM seeds JOIN dims USING (r))"""]
    for i in range(rounds + 1):
        steps.append(f"""
d{i} AS (SELECT r, c, CAST(sum((x - m) * (x - m)) AS BIGINT) AS distance FROM dims JOIN m{i} USING (j) GROUP BY r, c),
a{i} AS MATERIALIZED (SELECT r, c, distance FROM d{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, c) = 1)""")
        if i < rounds:
            steps.append(f"""
s{i} AS (SELECT c, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{i} JOIN dims USING (r) GROUP BY c, j),
m{i + 1} AS MATERIALIZED (SELECT c, j, coalesce((s - (((s % n) + n) % n)) // n, m) AS m FROM m{i} LEFT JOIN s{i} USING (c, j))""")
    return "WITH" + ",".join(steps) + f""",
named AS (SELECT c, sha256(string_agg(CAST(m AS VARCHAR), ',' ORDER BY j)) AS centroid_sha256 FROM m{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN named USING (c) JOIN kept USING (r)"""


SQL = _sql()
