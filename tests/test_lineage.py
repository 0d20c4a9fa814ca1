"""Closure of descendants against a plain search on the driver."""

import random

import pytest

from sysloom.operators import lineage


def table(spark, forks):
    rows = [("h", c, p, t, "x") for p, c, t in forks]
    return spark.createDataFrame(rows, "host string, pid long, ppid long, fork_ts long, exec_file string")


def expected(forks, roots, strict):
    since = dict(roots)
    changed = True
    while changed:
        changed = False
        for p, c, t in forks:
            if p in since and (not strict or t >= since[p]) and (c not in since or (strict and t < since[c])):
                since[c] = t
                changed = True
    return set(since)


def got(spark, forks, roots, strict):
    root_df = spark.createDataFrame(list(roots.items()), "pid long, since long")
    return {r.pid for r in lineage.descendant_pids(table(spark, forks), root_df, [], strict_time=strict).collect()}


@pytest.mark.parametrize("strict", [False, True])
def test_long_chain(spark, strict):
    forks = [(i, i + 1, i) for i in range(1, 60)]
    assert got(spark, forks, {30: 0}, strict) == set(range(30, 61))


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("seed", range(3))
def test_random_forest_with_time(spark, seed, strict):
    rng = random.Random(seed)
    forks = [(rng.randint(0, c - 1), c, rng.randint(0, 50)) for c in range(1, 80)]
    roots = {rng.randint(0, 79): rng.randint(0, 30) for _ in range(3)}
    assert got(spark, forks, roots, strict) == expected(forks, roots, strict)


@pytest.mark.parametrize("strict", [False, True])
def test_cycle_ends(spark, strict):
    forks = [(3, 1, 1), (1, 2, 2), (2, 3, 3), (9, 10, 1)]
    assert got(spark, forks, {9: 0}, strict) == {9, 10}
    assert got(spark, forks, {2: 0}, strict) == expected(forks, {2: 0}, strict)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("seed", range(2))
def test_reused_ids(spark, seed, strict):
    rng = random.Random(seed)
    forks = [(rng.randint(0, 25), rng.randint(0, 25), rng.randint(0, 50)) for _ in range(40)]
    roots = {3: 5, 7: 20}
    assert got(spark, forks, roots, strict) == expected(forks, roots, strict)


def test_a_later_life_of_an_id_has_its_own_parent(spark):
    # 5 is forked by the tracked 1 at 10, and after its end by 9 at 50: a child at 20 and one at 60 belong to different lives
    forks = [(1, 5, 10), (9, 5, 50), (5, 6, 20), (5, 7, 60), (9, 8, 5), (8, 3, 6)]
    lives = lineage.incarnations(table(spark, forks), [], strict_time=True)
    assert {(r.pid, r.k, r.ppid, r.up) for r in lives.collect()} == {(5, 1, 1, None), (5, 2, 9, None), (6, 1, 5, 1), (7, 1, 5, 2), (8, 1, 9, None), (3, 1, 8, 1)}
    # the kernel's table keeps 5 all the same
    assert got(spark, forks, {1: 0}, True) == {1, 5, 6, 7}


@pytest.mark.parametrize("again", [[], [(900, 45, 1000)]])
def test_long_chain_with_a_reused_id(spark, again):
    forks = [(i, i + 1, i) for i in range(1, 60)] + again
    assert got(spark, forks, {30: 0}, True) == set(range(30, 61))


def test_equal_ids_of_two_hosts(spark):
    rows = [("a", 2, 1, 5, "x"), ("a", 3, 2, 6, "x"), ("b", 3, 2, 6, "x"), ("b", 4, 3, 7, "x")]
    p = spark.createDataFrame(rows, "host string, pid long, ppid long, fork_ts long, exec_file string")
    roots = spark.createDataFrame([("a", 1, 0), ("b", 3, 0)], "host string, pid long, since long")
    for strict in (False, True):
        found = lineage.descendant_pids(p, roots, ["host"], strict)
        assert {(r.host, r.pid, r.since) for r in found.collect()} == {("a", 1, 0), ("a", 2, 5), ("a", 3, 6), ("b", 3, 0), ("b", 4, 7)}


def test_markers_scope_and_siblings(spark):
    rows = [("a", 5, 4, 10, "/tmp/DT_INIT", "/tmp/DT_INIT", "m1"), ("a", 6, 4, 12, "/bin/sh", "sh", "m1"), ("b", 6, 4, 12, "/bin/sh", "sh", "m1"),
            ("b", 5, 9, 1, "/tmp/DT_INIT2", "/tmp/DT_INIT2", "m2")]
    p = spark.createDataFrame(rows, "host string, pid long, ppid long, fork_ts long, exec_file string, cmdline string, mnt_ns string")
    roots = lineage.marker_roots(p, ["host"])
    assert [tuple(r) for r in roots.collect()] == [("a", 4, 10)]
    tracked = lineage.descendant_pids(p, roots, ["host"])
    assert {(r.host, r.pid) for r in tracked.collect()} == {("a", 4), ("a", 5), ("a", 6)}
    assert lineage.scope_events(p, tracked, ["host"]).count() == 2
    assert lineage.tracked_pid_count(tracked, ["host"]).first().tracked_pids == 3
    assert {(r.host, r.pid) for r in lineage.namespace_siblings(p, "DT_INIT").collect()} == {("a", 5), ("a", 6), ("b", 5)}
