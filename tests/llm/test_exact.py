"""Exact groups from streamed state, against plain Python."""

import hashlib
import random
import re

import pytest

from sysloom.llm import exact
from sysloom.llm.queries import QUERIES, SQL


def norm(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[norm(t)]
        top = max((x for x in ids if x is not None), default=None)
        out.append((i, top, len(ids), hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


def write(spark, rows, path, schema="doc_id long, text string", parts=3):
    spark.createDataFrame(rows, schema).repartition(parts).write.mode("append").parquet(path)


def check(found, rows):
    found = found.collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=str) == brute(rows)
    stays = [r for r in found if r.kept]
    assert len(stays) == len({norm(t) for _, t in rows}) and all(r.doc_id == r.keep_id for r in stays)


ODD = [(1, "A b"), (2, "a B"), (3, "a b"), (4, "É"), (5, "é"), (6, None), (7, ""), (8, " "), (9, "a b "), (9, "A B"), (None, "a b"),
       (None, "none"), (None, "NONE"), (10, "x" * 300_000), (11, "X" * 300_000), (11, "X" * 300_000), (12, "İ"), (13, "K"), (14, "k"), (15, "a\x00b")]


@pytest.mark.parametrize("batch_bytes", [1, 1 << 30])
def test_odd_rows_in_one_or_many_batches(spark, tmp_path, batch_bytes):
    write(spark, ODD, str(tmp_path / "in"))
    check(exact.deduplicate(spark, str(tmp_path / "in"), batch_bytes=batch_bytes), ODD)


def test_state_goes_on_with_later_files(spark, tmp_path):
    rnd = random.Random(3)
    rows, path, place = [], str(tmp_path / "in"), str(tmp_path / "state")
    for step in range(3):
        new = [(1000 * step + i, rnd.choice("ABab") * rnd.randrange(1, 40)) for i in range(150)]
        rows += new
        write(spark, new, path)
        check(exact.deduplicate(spark, path, checkpoint=place), rows)
    # nothing new: the state stays as it is
    before = sorted(map(str, exact.state(spark, place).collect()))
    check(exact.deduplicate(spark, path, checkpoint=place), rows)
    assert sorted(map(str, exact.state(spark, place).collect())) == before
    assert sum(r.n for r in exact.state(spark, place).collect()) == len(rows)


@pytest.mark.parametrize("limit", [0, 10**6])
@pytest.mark.parametrize("key_bytes", [1, 2])
def test_full_bytes_settle_colliding_digests(spark, tmp_path, monkeypatch, key_bytes, limit):
    monkeypatch.setattr(exact, "BROADCAST_ROWS", limit)
    rnd = random.Random(4)
    rows = [(i, f"text {rnd.randrange(400)}") for i in range(900)] + [(1000 + i, "hot") for i in range(500)]
    write(spark, rows, str(tmp_path / "in"))
    check(exact.deduplicate(spark, str(tmp_path / "in"), key_bytes=key_bytes), rows)


def test_other_columns_text_ids_and_an_empty_table(spark, tmp_path):
    schema = "doc_id string, text string, id int, n int, file string, at int, digest string, full string, keep_id int, value int"
    rows = [(f"d{i}", f"T{i % 7}", 1, 1, "f", 1, "d", "f", 1, 1) for i in range(40)]
    write(spark, rows, str(tmp_path / "in"), schema)
    check(exact.deduplicate(spark, str(tmp_path / "in")), [r[:2] for r in rows])
    write(spark, [], str(tmp_path / "none"))
    assert exact.deduplicate(spark, str(tmp_path / "none")).count() == 0


def test_query_has_no_python_in_its_plan(spark, capsys):
    out = QUERIES["op12_exact"](spark, "/root/testdata/sf0.001")
    out.explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    data = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    check(out, data)
    assert "op12_exact" in SQL
