"""Quality by Bradley-Terry ranking of document pairs.

A document's strength is a weighted sum of features of its whole text.  Training pairs set a
document labelled good against one labelled poor; the chance that the good one wins is the
logistic function of the difference of strengths, and the weights minimise the logistic loss
on the differences of features.  Newton's method needs a gradient and a small matrix per
round, which tasks sum over their pairs.

Pairs are dealt, not crossed: each document meets ``PAIRS`` of the other class, found by
joining consecutive slots of the two classes; slots go by a hash of document and text, so copies
of a text spread over all of them.  All rows given to ``fit`` are learned from, and the registered
query gives all labelled documents that are not held out.  The threshold is the quantile of strengths
that leaves as many labelled documents below as are labelled poor; scores are a logistic
function of the strength that takes ``threshold`` at that quantile.

Rows: null and empty texts have features of zero and get a score.  Labels other than 0 and 1
are not learned from; if a class is missing all scores are 1, 0 or (without labels) 0.5.
Repeated rows score alike; an empty table gives an empty result.  The columns of the result
replace input columns of the same name; other columns are kept but not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, drop_shuffles, release
from . import features, textscan

PAIRS = 8
ROUNDS = 10
RIDGE = 1e-3
_KINDS = np.zeros((5, 256), bool)
_KINDS[0, ord("A"):ord("Z") + 1] = True
_KINDS[1, ord("a"):ord("z") + 1] = True
_KINDS[2, ord("0"):ord("9") + 1] = True
_KINDS[3, [b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,"]] = True
_KINDS[4, 128:] = True
FEATURES = (
    "letters upper", "letters lower", "digits", "marks", "other scripts", "words ending in a mark", "words of marks", "words in upper case",
    "words equal to the last", "different words", "mean word length", "long words", "short words", "words", "lines", "words per line", "repeated lines", "sentence ends")


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` per document: shares, and logarithms of sizes."""
    docs = len(offsets) - 1
    sizes = np.maximum(np.diff(offsets), 1)
    out = np.zeros((docs, len(FEATURES)))
    of_byte = np.repeat(np.arange(docs), np.diff(offsets))
    for k in range(5):
        out[:, k] = np.bincount(of_byte[_KINDS[k][data]], minlength=docs) / sizes
    starts, ends, before = textscan.word_bounds(data, offsets)
    count = np.diff(before)
    doc, many = np.repeat(np.arange(docs), count), np.maximum(count, 1)
    share = lambda chosen: np.bincount(doc[chosen], minlength=docs) / many
    words, length = textscan.word_hashes(data, starts, ends), ends - starts
    if len(starts):
        marks = np.concatenate([[0], np.cumsum(_KINDS[3][data])])
        upper, lower = (np.concatenate([[0], np.cumsum(_KINDS[k][data])]) for k in (0, 1))
        all_marks = marks[ends] - marks[starts] == length
        out[:, 5], out[:, 6] = share(_KINDS[3][data[ends - 1]]), share(all_marks)
        out[:, 7] = share((upper[ends] - upper[starts] > 1) & (lower[ends] == lower[starts]))
        again = np.zeros(len(words), bool)
        again[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
        out[:, 8] = share(again)
        order = np.lexsort((words, doc))
        fresh = np.ones(len(words), bool)
        fresh[1:] = (words[order][1:] != words[order][:-1]) | (doc[order][1:] != doc[order][:-1])
        # the share of different words falls with length: put in relation to a root of it
        different = np.bincount(doc[order][fresh], minlength=docs)
        out[:, 9] = np.log1p(different) - 0.8 * np.log1p(count)
        out[:, 10] = np.bincount(doc, length, minlength=docs) / many / 10
        out[:, 11], out[:, 12] = share(length > 20), share(length <= 3)
        out[:, 17] = share((data[ends - 1] == ord(".")) | (data[ends - 1] == ord("?")))
    out[:, 13] = np.log1p(count) / 10
    lines = np.bincount(of_byte[data == 10], minlength=docs) + 1
    out[:, 14], out[:, 15] = np.log(lines) / 10, np.log1p(count / lines) / 10
    if len(starts):
        # a line's hash is the sum of its words' hashes, placed within the line
        line_of = np.cumsum(np.concatenate([[0], data == 10]))[starts]
        first = np.ones(len(starts), bool)
        first[1:] = (line_of[1:] != line_of[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(first)
        within = np.arange(len(starts)) - np.repeat(at, np.diff(np.append(at, len(starts))))
        hashes = np.add.reduceat(textscan.mix(words + within.astype(np.uint64)), at)
        owner = doc[at]
        order = np.lexsort((hashes, owner))
        copy = np.zeros(len(at), bool)
        copy[1:] = (hashes[order][1:] == hashes[order][:-1]) & (owner[order][1:] == owner[order][:-1])
        out[:, 16] = np.bincount(owner[order][copy], minlength=docs) / np.maximum(np.bincount(owner, minlength=docs), 1)
    return out


def _expand(x: np.ndarray) -> np.ndarray:
    """Features, their square roots, so that a small share already shows, and presence."""
    return np.hstack([x, np.sqrt(np.abs(x)), np.clip(10 * np.abs(x[:, :9]), 0, 1)])


def _of_column(column: pa.Array) -> np.ndarray:
    data, offsets = textscan.utf8(column)
    parts = [text_features(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]) for a, b in textscan.groups(offsets)]
    return _expand(np.concatenate(parts) if parts else np.zeros((0, len(FEATURES))))


def pairs(rows: DataFrame, count: int) -> DataFrame:
    """(good, poor) features: each document of either class meets about ``count`` of the other.

    Documents of a class are dealt to slots by hash, as many slots as the smaller class has
    rows; slot s of one class meets slots s to s + count - 1 of the other.  With the larger
    class spread evenly, a slot holds its size over the number of slots, on average.
    """
    sizes = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    slots = max(1, min(sizes.values()))
    slot = F.pmod(F.xxhash64("key", "label"), F.lit(slots))
    good = rows.filter("label = 1").select(slot.alias("slot"), F.col("x").alias("good"))
    poor = rows.filter("label = 0").select(slot.alias("at"), F.col("x").alias("poor"))
    poor = poor.select("poor", F.explode(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.pmod(F.col("at") + k, F.lit(slots)))).alias("slot"))
    return good.join(poor, "slot").select("good", "poor")


def fit(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray, float, float] | float:
    """Feature scales, weights, the threshold's strength and the spread of strengths;
    a constant score if there is no pair to learn from."""
    usable = features.keyed(labelled.filter("label in (0, 1)"))
    sizes = {r.label: r["count"] for r in usable.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return {0: 0.0, 1: 1.0}.get(next(iter(sizes), None), 0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _of_column(batch.column(2))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["key", "label", "x"])

    rows = cut_lineage(usable.select("key", "label", "text").mapInArrow(run, "key long, label int, x array<double>"))
    drop_shuffles(rows.sparkSession)
    width = _expand(np.zeros((1, len(FEATURES)))).shape[1]
    stats = rows.agg(*[F.stddev_pop(F.get("x", F.lit(k))) for k in range(width)]).first()
    scale = np.array([1 / s if s and s > 1e-9 else 0.0 for s in stats])
    dealt = cut_lineage(pairs(rows, PAIRS))
    weights = np.zeros(width)

    for _ in range(ROUNDS):
        def sums(frames: Iterator[pd.DataFrame], weights=weights) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if not len(frame):
                    continue
                d = (np.stack(frame["good"]) - np.stack(frame["poor"])) * scale
                miss = 1 / (1 + np.exp(np.clip(d @ weights, -35, 35)))
                yield pd.DataFrame({"g": [(d.T @ miss).tolist()], "h": [((d * (miss * (1 - miss))[:, None]).T @ d).ravel().tolist()], "n": [len(d)]})

        # one row per batch of pairs, each of fixed size, added up by Spark
        parts = dealt.mapInPandas(sums, "g array<double>, h array<double>, n long").select(F.posexplode(F.concat("g", "h")), "n")
        total = parts.groupBy("pos").agg(F.sum(F.round(F.col("col") * (1 << 20)).cast("long")).alias("v"), F.sum("n").alias("n")).orderBy("pos").collect()
        if not total:
            break
        count, values = total[0].n, np.array([r.v for r in total]) / (1 << 20)
        gradient = values[:width] / count - RIDGE * weights
        step = np.linalg.solve(values[width:].reshape(width, width) / count + (RIDGE + 1e-4) * np.eye(width), gradient)
        norm = np.abs(step).max()
        weights = weights + step / max(1.0, norm / 3)
        if norm < 1e-3:
            break

    w = weights * scale
    strength = F.aggregate(F.zip_with("x", F.lit(w.tolist()), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    ranked = rows.select("label", strength.alias("s"))
    poor_share = sizes[0] / sum(sizes.values())
    cut, low, high = ranked.agg(F.percentile_approx("s", [poor_share, 0.25, 0.75], 10_000)).first()[0]
    # the gap around the quantile: the threshold lies in the middle of it
    ends = ranked.agg(F.max(F.when(F.col("s") <= cut, F.col("s"))).alias("a"), F.min(F.when(F.col("s") > cut, F.col("s"))).alias("b")).first()
    middle = cut if ends.b is None else (ends.a + ends.b) / 2
    release(rows, dealt)
    return scale, weights, float(middle), float(max(high - low, 1e-6))


def score(docs: DataFrame, model: tuple | float, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``."""
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = docs.select(*kept).schema.add("score", "double").add("predicted", "integer")
    place = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if isinstance(model, float):
                scores = np.full(batch.num_rows, model)
            else:
                scale, weights, middle, spread = model
                strength = (_of_column(batch.column(place)) * scale) @ weights
                shift = np.log(threshold / (1 - threshold))
                scores = 1 / (1 + np.exp(-np.clip((strength - middle) / spread + shift, -35, 35)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], [*kept, "score", "predicted"])

    return docs.select(*kept).mapInArrow(run, schema)
