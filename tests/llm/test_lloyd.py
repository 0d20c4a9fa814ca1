"""Clustering against plain integer arithmetic."""

import hashlib
import math
import random

import numpy as np
import pytest

from sysloom.llm import lloyd


def brute(rows, dimensions, clusters, rounds, scale=256):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dimensions and all(x is not None and np.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), tuple(v)) for i, v in kept if i is not None)[:clusters]
    centres = [list(v) for _, v in seeds]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centres))

    for _ in range(rounds):
        where = [nearest(v)[1] for _, v in kept]
        for k in set(where):
            mine = [v for (_, v), w in zip(kept, where) if w == k]
            centres[k] = [int(sum(v[j] for v in mine)) // len(mine) for j in range(dimensions)]
    found = [(i, *nearest(v)) for i, v in kept]
    total = sum(x[1] for x in found)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, int(k), int(s), int(sum(x[1] for x in found if x[2] == k)), int(total), sha[k]) for i, s, k in found), key=str)


def run(spark, rows, schema="vec_id long, embedding array<double>", **options):
    out = lloyd.cluster(spark.createDataFrame(rows, schema), **options)
    return sorted(map(tuple, out.collect()), key=str)


@pytest.mark.parametrize("dimensions,block,clusters", [(6, 2, 5), (7, 3, 4), (3, 16, 3), (5, 1, 1)])
def test_equals_plain_arithmetic(spark, dimensions, block, clusters):
    rnd = random.Random(dimensions)
    rows = [(i, [rnd.gauss(rnd.choice([-1, 1]), 0.3) for _ in range(dimensions)]) for i in range(200)]
    options = dict(dimensions=dimensions, clusters=clusters, rounds=4)
    assert run(spark, rows, block=block, **options) == brute(rows, **options)


def test_nulls_lengths_ties_and_repeated_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [0.5, 0.5]), (None, [9.0, 9.0]), (4, None), (5, []), (6, [1.0]),
            (7, [1.0, None]), (8, [nan, 0.0]), (9, [inf, 0.0]), (10, [1.0, 2.0, 3.0]), (11, [-0.001, -3.0])]
    rows += [(100 + i, [0.25, 0.25]) for i in range(60)]
    options = dict(dimensions=2, clusters=4, rounds=3)
    assert run(spark, rows, **options) == brute(rows, **options)


def test_wide_numbers_need_long_messages(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.uniform(-1e5, 1e5) for _ in range(4)]) for i in range(80)]
    options = dict(dimensions=4, clusters=6, rounds=3)
    assert run(spark, rows, **options) == brute(rows, **options)
    with pytest.raises(Exception, match="beyond"):
        run(spark, [(1, [1e300, 0.0, 0.0, 0.0])], **options)


def test_fewer_vectors_than_clusters_and_none(spark):
    rows = [(1, [0.0, 1.0]), (2, [5.0, 1.0])]
    options = dict(dimensions=2, clusters=40, rounds=2)
    assert run(spark, rows, **options) == brute(rows, **options)
    assert run(spark, [], **options) == [] and run(spark, [(None, [1.0, 2.0])], **options) == []


def test_clashing_columns_and_text_ids(spark):
    schema = "vec_id string, embedding array<float>, id int, row int, cluster int, messages string, x int, b0 int"
    rows = [(f"v{i}", [i / 8, -i / 4], 1, 1, 1, "m", 1, 1) for i in range(30)]
    options = dict(dimensions=2, clusters=3, rounds=3)
    assert run(spark, rows, schema, **options) == brute([r[:2] for r in rows], **options)


def test_model_bound():
    with pytest.raises(ValueError):
        lloyd.cluster(None, clusters=1 << 20)
