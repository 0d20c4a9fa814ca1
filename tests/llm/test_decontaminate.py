"""Spaced seeds and verified overlaps."""

import random

import duckdb

from sysloom.llm import decontaminate as dc
from sysloom.llm.queries import QUERIES, SQL
from tools.compare import compare


def words(rnd, n):
    return [f"w{rnd.randrange(5000)}" for _ in range(n)]


def test_leaks_with_substitutions_are_found(spark):
    rnd = random.Random(4)
    items = {k: words(rnd, n) for k, n in enumerate((14, 20, 40, 90, 600, 5, 7))}
    swap = lambda w, every: [x if (k + 2) % every else "other" for k, x in enumerate(w)]
    docs = {0: words(rnd, 300), 1: words(rnd, 50) + items[0] + words(rnd, 50), 2: swap(items[1], 5), 3: words(rnd, 9) + swap(items[2], 6),
            4: items[3][:30] + words(rnd, 200), 5: words(rnd, 100) + items[4][250:280], 6: swap(items[2], 2), 7: items[3][:10] + words(rnd, 30),
            8: items[5] + words(rnd, 20), 9: words(rnd, 3) + items[6], 10: items[1] + items[0]}
    rows = [(i, ", ".join(w).upper() if i == 1 else " ".join(w)) for i, w in docs.items()] + [(20, None), (21, ""), (22, "short"), (None, " ".join(items[1])), (10, " ".join(docs[10]))]
    bench = [(k, " ".join(w)) for k, w in items.items()] + [(50, None), (51, ""), (1, " ".join(items[1]))]
    table = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, item_id string")
    benchmark = spark.createDataFrame([(*b, 1) for b in bench], "item_id long, text string, doc_id int")
    found = dc.leaks(table, benchmark)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 0), (2, 1), (3, 2), (4, 3), (5, 4), (8, 5), (9, 6), (10, 1), (10, 0), (None, 1)}
    assert all(0.8 <= r.overlap <= 1 for r in found.collect())
    kept = dc.drop_leaks(table, benchmark)
    assert kept.columns == table.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 6, 7, 20, 21, 22]


def brute_force(docs, items, similarity=0.8, window=20):
    found = set()
    for i, own in docs.items():
        for k, item in items.items():
            width = min(len(item), window)
            for shift in range(1 - len(item), len(own)):
                same = [0 <= shift + x < len(own) and own[shift + x] == w for x, w in enumerate(item)]
                if any(sum(same[a:a + width]) / width >= similarity for a in range(len(item) - width + 1)):
                    found.add((i, k))
    return found


def test_short_items_are_found_as_without_masks(spark):
    rnd = random.Random(9)
    items = {n: [f"i{n}x{k}" for k in range(n)] for n in range(1, 21)}
    docs = {}
    for n, item in items.items():
        for wrong in range(0, min(3, n // 5 + 2)):
            for _ in range(6):
                at = set(rnd.sample(range(n), min(n, wrong)))
                edited = [f"q{rnd.random()}".replace(".", "") if k in at else w for k, w in enumerate(item)]
                docs[len(docs)] = words(rnd, rnd.choice((0, 3))) + edited[rnd.choice((0, 0, 1)):] + words(rnd, rnd.choice((0, 8)))
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in dc.leaks(table, benchmark).collect()}
    true = brute_force(docs, items)
    short = {x for x in true if x[1] < dc.SHORT_WORDS}
    assert short == {x for x in found if x[1] < dc.SHORT_WORDS} and len(short) > 100
    assert found <= true and len(true - found) <= 0.02 * len(true)


def test_sql_finds_short_items_too(spark, tmp_path):
    rnd = random.Random(10)
    items = {n: words(rnd, n) for n in (1, 3, 5, 8, 11, 12, 30)}
    texts = [words(rnd, 4) + item[:n] + words(rnd, 4) for n in (3, 5, 9, 30) for item in items.values()]
    spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = compare(spark, con, "op10", QUERIES["op10_decontaminate"], SQL["op10_decontaminate"], str(tmp_path))[0]
    assert got.startswith("ok") and got != "ok 0"


def test_documents_without_an_id_are_judged_one_by_one(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = spark.createDataFrame([(None, item), (None, "clean"), (1, "clean"), (2, item), (None, None)], "doc_id long, text string")
    kept = dc.drop_leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.filter("text is null or text = 'clean'").collect()))


def test_blocks_of_the_benchmark_give_the_same(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    once = sorted(map(tuple, QUERIES["op10_decontaminate"](spark, d).collect()))
    monkeypatch.setattr(dc, "BLOCK_SEEDS", 300)
    assert once and sorted(map(tuple, QUERIES["op10_decontaminate"](spark, d).collect())) == once


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    benchmark = spark.createDataFrame([], "item_id long, text string")
    full = spark.createDataFrame([(1, "a b c d e f g h i j")], "doc_id long, text string")
    assert dc.leaks(docs, benchmark).count() == 0 and dc.leaks(full, benchmark).count() == 0 and dc.drop_leaks(full, benchmark).count() == 1
    assert dc.leaks(docs, full.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_query_against_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    assert compare(spark, con, "op10", QUERIES["op10_decontaminate"], SQL["op10_decontaminate"], d)[0].startswith("ok")


def test_no_python_in_the_plan(spark, capsys):
    QUERIES["op10_decontaminate"](spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert "Broadcast" in plan and "Python" not in plan and "InPandas" not in plan and "Arrow" not in plan
