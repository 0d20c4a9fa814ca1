"""Whitening against a decomposition of the whole matrix."""

import random

import numpy as np
import pytest

from sysloom.llm import whitening


def brute(rows):
    kept = [(i, v) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    x = np.floor(1024 * np.array([v for _, v in kept], float)) + 100000
    n, s = len(x), x.sum(axis=0)
    y = (n * x - s) / n
    # of the rows themselves: squaring them first would lose the small directions
    _, singular, vectors = np.linalg.svd(y, full_matrices=False)
    away = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    return [i for i, _ in kept], y, singular ** 2 / n, vectors.T, away


def compare(spark, rows, keep=8, schema="vec_id long, embedding array<double>"):
    found = whitening.whiten(spark.createDataFrame(rows, schema), keep=keep).collect()
    ids, y, values, vectors, away = brute([r[:2] for r in rows])
    count = len({r.component for r in found})
    assert len(found) == len(ids) * count
    for k in range(count):
        want = y @ vectors[:, k] / np.sqrt(values[k])
        got = {}
        for r in found:
            if r.component == k + 1:
                got.setdefault(r.vec_id, r)
                assert r.explained == pytest.approx(values[k] / values.sum(), rel=1e-9) and r.identity_error <= 1e-9 and r.n == len(ids)
        sign = 1 if got[ids[int(abs(want).argmax())]].whitened * want[int(abs(want).argmax())] > 0 else -1
        assert all(abs(sign * got[i].whitened - w) < 1e-8 and got[i].deviation == d for i, w, d in zip(ids, want, away))
    return count


def test_equals_a_decomposition(spark):
    rnd = np.random.default_rng(1)
    mix = rnd.normal(size=(12, 12))
    rows = [(i, v.tolist()) for i, v in enumerate(rnd.normal(size=(500, 12)) @ mix)]
    assert compare(spark, rows) == 8
    assert compare(spark, rows[:40], keep=20) == 12


def test_nearly_dependent_and_badly_scaled_dimensions(spark):
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(400, 5)) * [1e3, 100, 1, 0.1, 0.02]
    x = np.concatenate([x, x[:, :1] + rnd.normal(size=(400, 1)) * 0.01], axis=1)
    assert compare(spark, [(i, v.tolist()) for i, v in enumerate(x)], keep=4) == 4


def test_directions_without_variance_have_no_component(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(100):
        a, b = rnd.randrange(-2048, 2048) / 1024, rnd.randrange(-2048, 2048) / 1024
        rows.append((i, [a, b, a + b, 3.0]))
    assert compare(spark, rows) == 2
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(20)], "vec_id long, embedding array<double>")
    assert whitening.whiten(same).count() == 0
    assert whitening.whiten(same.limit(1)).count() == 0 and whitening.whiten(same.limit(0)).count() == 0


def test_odd_rows_are_left_out(spark):
    nan, inf = float("nan"), float("inf")
    rnd = random.Random(4)
    rows = [(i, [rnd.random() for _ in range(3)]) for i in range(50)]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [nan, 1.0, 1.0]), (104, [1.0, -inf, 1.0])]
    assert compare(spark, rows + odd) == 3
    other = spark.createDataFrame([*rows, (200, [1.0]), (201, [1.0] * 4)], "vec_id long, embedding array<double>")
    assert {r.vec_id for r in whitening.whiten(other).collect()} == set(range(50))


def test_repeated_rows_null_ids_and_other_columns(spark):
    rnd = random.Random(5)
    rows = [(f"v{i % 40}", [rnd.random() for _ in range(3)], i, 1, "c") for i in range(40)]
    schema = "vec_id string, embedding array<float>, x int, n int, component string"
    assert compare(spark, [(i, [float(np.float32(c)) for c in v], *more) for i, v, *more in rows], schema=schema) == 3
    twice = spark.createDataFrame([r for r in rows for _ in range(2)] + [(None, [0.5, 0.5, 0.5], 1, 1, "")], schema)
    assert whitening.whiten(twice).count() == 81 * 3


def test_beyond_64_bits(spark):
    large = spark.createDataFrame([(i, [1e6 * (i % 2), float(i)]) for i in range(10)], "vec_id long, embedding array<double>")
    found = whitening.whiten(large).collect()
    assert len(found) == 20 and all(r.deviation is None and np.isfinite(r.whitened) and r.identity_error < 1e-9 for r in found)
    rows = spark.createDataFrame([(i, [1e18 * (i - 1), 1.0]) for i in range(3)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits|overflow"):
        whitening.whiten(rows).count()
