"""Shards of near equal bytes with copies together."""

import random
import zlib

import pytest

from sysloom.llm import kdtree
from sysloom.llm.queries import QUERIES


def check(rows, data, shards, tolerance):
    """Sizes, checksums, slots and balance of a result."""
    size = lambda t: len((t or "").encode()) + 16
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted((str(i), size(t), zlib.crc32((t or "").encode())) for i, t in data)
    assert {r.law for r in rows} <= {"bytes"} and all(r.grown_shard is None and 0 <= r.shard < shards for r in rows)
    total = [0] * shards
    slots = {}
    for r in rows:
        total[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(total) / shards
    assert max(abs(t - mean) for t in total) <= tolerance * mean


@pytest.mark.parametrize("shards,tolerance", [(1, 0.0), (2, 0.003), (7, 0.005), (40, 0.03)])
def test_sizes_are_near_equal_and_copies_stay_together(spark, shards, tolerance):
    rnd = random.Random(shards)
    data = [(i, "".join(rnd.choice("abcé") for _ in range(rnd.randrange(20, 200)))) for i in range(3000)]
    data += [(5000 + i, data[i][1]) for i in range(100)]
    docs = spark.createDataFrame([(i, t, rnd.choice(["s0", "s0", f"s{i % 9}"]), rnd.choice(["en", "de"]), 1) for i, t in data], "doc_id long, text string, source string, lang string, shard int")
    rows = kdtree.shard(docs, shards).collect()
    check(rows, data, shards, tolerance)
    where, weight = {}, {}
    for r in rows:
        where.setdefault(r.text_crc32, set()).add(r.shard)
        weight[r.text_crc32] = weight.get(r.text_crc32, 0) + r.size
    limit = sum(weight.values()) / shards
    assert all(len(s) == 1 for k, s in where.items() if weight[k] <= limit)


def test_hot_text_nulls_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(kdtree, "BLOCK_ROWS", 20)
    rnd = random.Random(1)
    data = [(i, "hot text " * 5) for i in range(1500)] + [(2000 + i, "x" * rnd.randrange(60)) for i in range(1500)]
    data += [(None, None)] * 40 + [(7, "")] * 40 + [(9000 + i, None) for i in range(40)]
    docs = spark.createDataFrame([(i, t, None, None) for i, t in data], "doc_id long, text string, source string, lang string")
    check(kdtree.shard(docs, 10).collect(), data, 10, 0.15)


def test_texts_of_very_unequal_sizes_are_evened_out_with_copies_whole(spark):
    rnd = random.Random(4)
    data = [(i, "w" * int(20 * 2 ** rnd.uniform(0, 9))) for i in range(600)]
    # copies of one text weigh about half a shard, those of another more than one
    data += [(1000 + i, "half a shard " * 40) for i in range(140)] + [(2000 + i, "more than one " * 40) for i in range(400)]
    docs = spark.createDataFrame([(i, t, f"s{i % 3}", None) for i, t in data], "doc_id long, text string, source string, lang string")
    rows = kdtree.shard(docs, 8).collect()
    check(rows, data, 8, 0.01)
    halves, mean = {r.shard for r in rows if 1000 <= r.doc_id < 2000}, sum(r.size for r in rows) / 8
    assert len(halves) == 1 and sum(r.size for r in rows if r.doc_id >= 2000) > mean


def test_query_shards_are_within_a_hundredth(spark):
    rows = QUERIES["op4_kdtree"](spark, "/root/testdata/sf0.01").collect()
    total, where = [0] * 40, {}
    for r in rows:
        total[r.shard] += r.size
        where.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    mean = sum(total) / 40
    assert max(abs(t - mean) for t in total) <= 0.01 * mean
    assert all(len(s) == 1 for s in where.values())


def test_one_huge_text_and_empty_table(spark):
    data = [(0, "z" * 500_000)] + [(i, "y" * i) for i in range(1, 50)]
    docs = spark.createDataFrame([(i, t, "s", "l") for i, t in data], "doc_id long, text string, source string, lang string")
    check(kdtree.shard(docs, 4).collect(), data, 4, 4)
    assert kdtree.shard(docs.limit(0), 4).count() == 0


def test_query_has_no_python_in_its_plan(spark, capsys):
    d = "/root/testdata/sf0.001"
    out = QUERIES["op4_kdtree"](spark, d)
    out.explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    data = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    check(out.collect(), data, 40, 3)
