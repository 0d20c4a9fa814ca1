"""Stages of the pipeline on a small table with odd rows, and on the given documents."""

import corpus_pipeline as cp
import pytest

from sysloom.llm.simhash import text_fingerprint

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{D}/documents.parquet")
    odd = spark.createDataFrame([(1000, None, None, None, 0), (1001, "", "en", "s", 0), (1002, "12 34 ?!", "en", "s", 8)], docs.schema)
    docs = docs.unionByName(odd)
    out = [docs.collect()]
    for k, (name, stage) in enumerate(cp.STAGES):
        result = stage(spark, docs, D)
        assert k == len(cp.STAGES) - 1 or result.columns == docs.columns, name
        result.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs.collect())
    return out


def test_language_stage_rejects_what_has_no_letter_and_keeps_the_rest(kept):
    assert {r.doc_id for r in kept[0]} - {r.doc_id for r in kept[1]} == {1000, 1001, 1002}


def test_near_duplicate_stage_keeps_one_of_each_group(kept):
    fps = [text_fingerprint(r.text.encode()) for r in kept[2]]
    assert all((a ^ b).bit_count() > 4 for k, a in enumerate(fps) for b in fps[:k])
    left = {r.doc_id for r in kept[2]}
    for r in kept[1]:
        if r.doc_id not in left:
            assert any((text_fingerprint(r.text.encode()) ^ f).bit_count() <= 64 for f in fps)
    assert len(left) < len(kept[1])


def test_passage_stage_keeps_documents_and_first_occurrences(kept):
    assert [r.doc_id for r in sorted(kept[3])] == [r.doc_id for r in sorted(kept[2])]
    before = {r.doc_id: r.text for r in kept[2]}
    assert all(r.n_chars == len(r.text) and len(r.text) <= len(before[r.doc_id]) for r in kept[3])
    runs = {}
    for r in sorted(kept[3]):
        w = r.text.split()
        for k in range(len(w) - 49):
            assert runs.setdefault(tuple(w[k:k + 50]), r.doc_id) == r.doc_id


def test_leaks_go_and_all_others_are_encoded(kept, spark):
    items = [r.text for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    assert not any(item in r.text for r in kept[4] for item in items)
    assert {r.doc_id for r in kept[3]} - {r.doc_id for r in kept[4]} >= {r.doc_id for r in kept[3] if any(i in r.text for i in items)}
    assert sorted(r.doc_id for r in kept[5]) == sorted(r.doc_id for r in kept[4])
    assert all(r.n_tokens > 0 or r.n_chars == 0 for r in kept[5])


def test_run_is_registered(spark):
    import __spark_entry__ as entry
    assert entry.queries()["pipeline"] is cp.run
    rows = cp.run(spark, D).collect()
    assert 0 < len(rows) <= 200 and {"doc_id", "n_tokens"} <= set(rows[0].asDict())
