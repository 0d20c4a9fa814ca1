"""Toxicity by FTRL-proximal logistic regression over hashed n-grams and skip-grams.

Features are the presence of words, word starts, bigrams and one-word skip-grams, hashed to
``2 ** BITS`` buckets.  FTRL-proximal keeps a learning rate for each coordinate, and its L1
term sets the weights of buckets without evidence to exactly zero, so the model that travels
with the plan is a short list of buckets and weights, bounded by the bucket count.

Training streams over the rows in shards of about ``SHARD_DOCS``; each is passed over once, then Spark
averages how far the shards moved a coordinate, and every shard goes on from there.  Rows are
dealt to shards by a hash of document and text, so copies of a text spread over all of them.
Their texts are shuffled once and their buckets written once, by shard and as differences, and
the rounds read them from there without a shuffle.
All rows given to ``fit`` are learned from, and the registered query gives all labelled documents
that are not held out.  Scoring reads every whole text.

Rows: a null or empty text has the bias as its only feature and gets a score.  Labels other
than 0 and 1 are not learned from; if a class is missing, the score is the share of class 1
(0.5 without labels).  A document with several labels counts once for each.  Repeated rows
score alike; an empty table gives an empty result.  The columns of the result replace input
columns of the same name; other columns are kept but not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, drop_shuffles, release
from . import features

BITS = 24
#: Documents of a shard, on average.
SHARD_DOCS = 5_000
#: Sight of a coordinate from which on it is learned: rarer ones only recall single documents.
INCLUDED = 3
#: Coordinates that moved less in a shard's pass are left where they were.
DROPPED = 0.25
ROUNDS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 6.0, 1.0
_BIAS = 1 << BITS


def _weights(z: np.ndarray, n: np.ndarray, bias: np.ndarray) -> np.ndarray:
    shrunk = np.sign(z) * np.maximum(np.abs(z) - np.where(bias, 0, L1), 0)  # the bias is not made sparse
    return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)


class Ftrl:
    """State of FTRL-proximal: sums of adjusted gradients and of squared gradients.

    Only coordinates that are learned have a slot; ``place`` holds the slots and, below zero, the
    sights of the others.  Slot 0 stays empty, slot 1 is the bias.
    """

    def __init__(self, bucket: np.ndarray, z: np.ndarray, n: np.ndarray):
        self.place, self.slots = np.zeros(_BIAS + 1, np.int32), 1
        self.bucket, self.touched = np.zeros(1, np.int64), np.zeros(1, bool)
        self.z, self.n = np.zeros((2, 1), np.float32)
        self._add(np.array([_BIAS]))
        self._add(bucket[bucket != _BIAS])
        at = self.place[bucket]
        self.z[at], self.n[at] = z, n
        self.start = self.z[:self.slots].copy(), self.n[:self.slots].copy()

    def _add(self, buckets: np.ndarray) -> None:
        first, self.slots = self.slots, self.slots + len(buckets)
        if self.slots > len(self.z):
            longer = lambda x: np.concatenate([x, np.zeros(self.slots, x.dtype)])
            self.bucket, self.touched, self.z, self.n = map(longer, (self.bucket, self.touched, self.z, self.n))
        self.bucket[first:self.slots], self.place[buckets] = buckets, np.arange(first, self.slots)

    def learn(self, buckets: np.ndarray, label: int) -> None:
        rare = buckets[self.place[buckets] <= 0]
        self.place[rare] -= 1
        self._add(rare[self.place[rare] == -INCLUDED])
        at = self.place[buckets]
        at = np.append(at[at > 0], 1)
        z, n = self.z[at], self.n[at]
        w = _weights(z, n, at == 1)
        gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        squared = n + gradient * gradient
        self.z[at] += gradient - (np.sqrt(squared) - np.sqrt(n)) / ALPHA * w
        self.n[at] = squared
        self.touched[at] = True

    def moves(self) -> pa.RecordBatch:
        """How far the coordinates that were met have moved."""
        z, n = self.z[:self.slots].copy(), self.n[:self.slots].copy()
        for now, start in zip((z, n), self.start):
            now[:len(start)] -= start
        far = self.touched[:self.slots] & (np.abs(z) > DROPPED)
        return pa.RecordBatch.from_arrays([pa.array(x[far]) for x in (self.bucket[:self.slots], z.astype(float), n.astype(float))], ["bucket", "z", "n"])


def _features_of(rows: DataFrame) -> DataFrame:
    """(shard, key, label, buckets): distinct feature buckets of each labelled text, ascending."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, doc, bucket in features.per_group(batch.column(3), BITS):
                pairs = np.unique(doc << (BITS + 1) | bucket)
                bounds = np.searchsorted(pairs >> (BITS + 1), np.arange(b - a + 1))
                values = pa.array((pairs & ((1 << (BITS + 1)) - 1)).astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(3)), lists], ["shard", "key", "label", "buckets"])

    return rows.select("shard", "key", "label", "text").mapInArrow(run, "shard int, key long, label int, buckets array<int>")


def dealt(usable: DataFrame, shards: int) -> DataFrame:
    """The features of (key, label, text) as a table in buckets of whole shards.

    Ascending numbers take about half the space as differences, which Parquet's second version writes.
    """
    by_shard = usable.withColumn("shard", F.pmod("key", F.lit(shards)).cast("int")).repartition(shards, "shard")
    return cut_lineage(_features_of(by_shard), (shards, "shard"), **{"parquet.writer.version": "v2"})


def in_order(rows: DataFrame) -> DataFrame:
    """Whole shards, one after the other and each by key and label; sorted where they lie."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("shard").orderBy("key", "label")))


def fit(labelled: DataFrame, rounds: int = ROUNDS) -> pd.DataFrame:
    """Non-zero weights by bucket, learned from (text, label) and, where there is one, doc_id."""
    usable = features.keyed(labelled.filter("label in (0, 1)"))
    sizes = {r.label: r["count"] for r in usable.groupBy("label").count().collect()}
    if len(sizes) < 2:
        rate = {0: 0.0, 1: 1.0}.get(next(iter(sizes), None), 0.5)
        return pd.DataFrame({"bucket": [_BIAS], "weight": [np.log((rate + 1e-6) / (1 - rate + 1e-6))]})
    shards = -(-sum(sizes.values()) // SHARD_DOCS)
    rows = dealt(usable, shards)
    drop_shuffles(rows.sparkSession)
    state = pd.DataFrame({"bucket": np.zeros(0, np.int64), "z": np.zeros(0), "n": np.zeros(0)})
    for _ in range(rounds):
        start = tuple(state[c].to_numpy() for c in ("bucket", "z", "n"))

        def run(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            now, model = None, None
            for batch in batches:
                lists = batch.column("buckets")
                bounds, values = lists.offsets.to_numpy(), lists.values.to_numpy()
                for shard, label, a, b in zip(batch.column("shard").to_pylist(), batch.column("label").to_pylist(), bounds[:-1], bounds[1:]):
                    if shard != now:
                        if model:
                            yield model.moves()
                        now, model = shard, None  # the old one is let go before there is a new one
                        model = Ftrl(*start)
                    model.learn(values[a:b], label)
            if model:
                yield model.moves()

        moved = in_order(rows).mapInArrow(run, "bucket long, z double, n double")
        # mean over the shards that met a coordinate; rounded, so that the order of the tasks does not show
        mean = lambda c: (F.sum(F.round(F.col(c) * (1 << 24)).cast("long")) / F.count("*") / (1 << 24)).alias(c)
        moved = moved.groupBy("bucket").agg(mean("z"), mean("n")).toArrow().to_pandas()
        drop_shuffles(rows.sparkSession)
        state = pd.concat([state, moved]).groupby("bucket", as_index=False).sum()
    release(rows)
    at = state["bucket"].to_numpy()
    weights = _weights(*(state[c].to_numpy(np.float32) for c in ("z", "n")), at == _BIAS).astype(float)
    return pd.DataFrame({"bucket": at[weights != 0], "weight": weights[weights != 0]})


def score(docs: DataFrame, weights: pd.DataFrame, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``."""
    buckets, values = weights["bucket"].to_numpy(), weights["weight"].to_numpy()
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = docs.select(*kept).schema.add("score", "double").add("predicted", "integer")
    place = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(_BIAS + 1, np.float32)
        table[buckets] = values
        for batch in batches:
            total = np.full(batch.num_rows, float(table[_BIAS]))
            for a, b, doc, bucket in features.per_group(batch.column(place), BITS):
                hit = table[bucket] != 0
                pairs = np.unique(doc[hit] << (BITS + 1) | bucket[hit])
                total[a:b] += np.bincount(pairs >> (BITS + 1), table[pairs & ((1 << (BITS + 1)) - 1)], minlength=b - a)
            scores = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], [*kept, "score", "predicted"])

    return docs.select(*kept).mapInArrow(run, schema)
