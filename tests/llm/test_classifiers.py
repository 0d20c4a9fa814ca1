"""Toxicity and quality: learning, odd input, accuracy on held-out rows."""

import random
import zlib

import numpy as np
import pytest

from sysloom.llm import features, quality, textscan, toxicity
from sysloom.llm import queries as corpus
from sysloom.llm.queries import QUERIES
from sysloom.session import release

D = "/root/testdata/sf0.01"
WORDS = "the of and river stone table green walk slow light cloud winter paper road house".split()


def sentence(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def test_grams_of_words_starts_pairs_and_skips():
    texts = ["One two, THREE", "", "one", "naïve café"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *[len(t.encode()) for t in texts]])
    doc, bucket = features.gram_hashes(data, offsets, 24)
    # words, the long word's start, two pairs and one skip; a start for each of two words
    assert np.bincount(doc, minlength=4).tolist() == [3 + 1 + 2 + 1, 0, 1, 2 + 3 + 1]
    assert set(bucket[doc == 2].tolist()) <= set(bucket[doc == 0].tolist())


def test_word_hashes_depend_on_the_bytes_alone():
    data = np.frombuffer(b"ab abc ab  c ab", np.uint8)
    s, e, before = textscan.word_bounds(data, np.array([0, 6, 15]))
    h = textscan.word_hashes(data, s, e)
    assert [bytes(data[a:b]) for a, b in zip(s, e)] == [b"ab", b"abc", b"ab", b"c", b"ab"] and before.tolist() == [0, 2, 5]
    assert h[0] == h[2] == h[4] and len(set(h.tolist())) == 3
    s, e, before = textscan.word_bounds(np.frombuffer(b"abcd", np.uint8), np.array([0, 2, 2, 4]))
    assert s.tolist() == [0, 2] and before.tolist() == [0, 1, 1, 2]


def test_toxicity_learns_marks_and_leaves_other_weights_at_zero(spark):
    rnd = random.Random(1)
    rows = [(sentence(rnd, 60) + (" vile scum " if k % 4 == 0 else " ") + sentence(rnd, 60), int(k % 4 == 0)) for k in range(400)]
    weights = toxicity.fit(spark.createDataFrame([*rows, ("x", 7), ("y", None)], "text string, label int"))
    assert 0 < len(weights) < 400
    new = [(1, sentence(rnd, 300)), (2, sentence(rnd, 90) + " vile scum"), (3, None), (4, ""), (5, "VILE SCUM! " + sentence(rnd, 9000)), (1, "vile scum")]
    docs = spark.createDataFrame([(*r, "old", 3.0) for r in new], "doc_id long, text string, predicted string, score double")
    rows = toxicity.score(docs, weights).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    # without a word only the bias speaks, alike for null and empty
    assert len({r.score for r in rows if r.doc_id in (3, 4)}) == 1
    assert sorted((r.doc_id, r.predicted) for r in rows if r.doc_id not in (3, 4)) == [(1, 0), (1, 1), (2, 1), (5, 1)]
    assert toxicity.score(docs.limit(0), weights).count() == 0


def test_quality_ranks_pairs(spark):
    rnd = random.Random(2)
    bad = lambda: rnd.choice([sentence(rnd, 80).upper().replace(" ", "!! "), " ".join(w + "&&&" for w in sentence(rnd, 80).split()), (rnd.choice(WORDS) + " ") * 80])
    rows = [(sentence(rnd, rnd.randrange(20, 200)).capitalize() + ".", 1) for _ in range(300)] + [(bad(), 0) for _ in range(80)] + [("z", None)]
    model = quality.fit(spark.createDataFrame(rows, "text string, label int"))
    new = [(1, sentence(rnd, 3000)), (2, bad()), (3, None), (4, ""), (5, bad() * 30), (6, "!"), (7, "\n\n")]
    docs = spark.createDataFrame([(*r, "old") for r in new], "doc_id long, text string, score string")
    got = {r.doc_id: (r.predicted, r.score) for r in quality.score(docs, model).collect()}
    assert got[1][0] == 1 and got[2][0] == got[5][0] == 0 and all(0 <= s <= 1 for _, s in got.values()) and len(got) == 7
    assert quality.score(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("module", [toxicity, quality])
@pytest.mark.parametrize("labels,low,high", [([], 0.5, 0.5), ([1, 1], 0.99, 1), ([0], 0, 0.01)])
def test_one_class_or_none(spark, module, labels, low, high):
    model = module.fit(spark.createDataFrame([("text", x) for x in labels], "text string, label int"))
    row = module.score(spark.createDataFrame([(1, "some text")], "doc_id long, text string"), model).first()
    assert low <= row.score <= high


def test_pairs_are_dealt_not_crossed(spark):
    rows = spark.createDataFrame([(k, int(k < 900), [float(k)]) for k in range(1000)], "key long, label int, x array<double>")
    dealt = quality.pairs(rows, 8)
    assert 900 * 8 * 0.7 < dealt.count() < 900 * 8 * 1.3
    assert dealt.filter("good[0] >= 900 or poor[0] < 900").count() == 0


def test_copies_of_a_labelled_text_spread_over_slots(spark):
    docs = [(k, "the same text" if k % 3 == 0 else f"text {k}", int(k % 2 == 0)) for k in range(3000)]
    docs = spark.createDataFrame([*docs, *docs[:50]], "doc_id long, text string, label int")
    rows = features.keyed(docs).selectExpr("key", "label", "array(1.0D) AS x")
    assert rows.select("key").distinct().count() == 3000
    assert rows.selectExpr("pmod(key, 6) AS shard").groupBy("shard").count().agg({"count": "max"}).first()[0] < 1.3 * 3050 / 6
    assert quality.pairs(rows, 8).count() < 2 * 8 * 3050


def test_repeated_texts_and_labels_are_learned_from(spark):
    rnd = random.Random(3)
    rows = [(k, "vile scum again" if k % 3 == 0 else sentence(rnd, 30), int(k % 3 == 0)) for k in range(300)]
    table = spark.createDataFrame([*rows, *rows[:30], (1, rows[1][1], 1)], "doc_id long, text string, label int")
    docs = spark.createDataFrame([(1, "a vile scum again"), (2, sentence(rnd, 30))], "doc_id long, text string")
    for module in (toxicity, quality):
        scored = {r.doc_id: r.score for r in module.score(docs, module.fit(table)).collect()}
        assert all(0 <= x <= 1 for x in scored.values())
        if module is toxicity:
            assert scored[1] > 0.5 > scored[2]


@pytest.mark.parametrize("name, module, label", [("op6_quality", quality, "quality"), ("op3_toxicity", toxicity, "toxic")])
def test_queries_learn_from_every_labelled_document(spark, tmp_path, monkeypatch, name, module, label):
    rnd = random.Random(7)
    spark.createDataFrame([(i, sentence(rnd, 20)) for i in range(400)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, i % 2, i % 2) for i in range(0, 400, 2)] + [(1, None, None), (3, 5, 5), (None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    given, module_fit = [], module.fit
    monkeypatch.setattr(module, "MAX_FIT_DOCS", 40, raising=False)
    monkeypatch.setattr(module, "fit", lambda rows: given.extend(r.doc_id for r in rows.collect()) or module_fit(rows))
    QUERIES[name](spark, str(tmp_path)).count()
    assert sorted(given) == [i for i in range(0, 400, 2) if zlib.crc32(str(i).encode()) % 4 != 2]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rounds_read_whole_shards_in_order_without_a_shuffle(spark):
    rnd = random.Random(8)
    usable = features.keyed(spark.createDataFrame([(k, sentence(rnd, 30), k % 2) for k in range(500)], "doc_id long, text string, label int"))
    rows = toxicity.dealt(usable, 4)
    ordered = toxicity.in_order(rows)
    assert "Exchange" not in plan_of(ordered)
    parts = ordered.rdd.glom().collect()
    seen = [[(r.shard, r.key, r.label) for r in part] for part in parts]
    assert all(part == sorted(part) for part in seen) and sum(map(len, seen)) == 500
    assert sum(len({s for s, _, _ in part}) for part in seen) == 4
    texts = {r.key: r for r in usable.collect()}
    for r in rows.take(20):
        data = np.frombuffer(texts[r.key].text.encode(), np.uint8)
        assert r.buckets == sorted(set(features.gram_hashes(data, np.array([0, len(data)]), toxicity.BITS)[1].tolist()))
    release(rows)


def test_texts_without_a_label_are_left_out_before_the_shuffle(spark, monkeypatch):
    docs = spark.range(20_000).selectExpr("id AS doc_id")
    ids = spark.createDataFrame([(k,) for k in range(0, 20_000, 50)] + [(-1,), (None,)], "doc_id int")
    got = {r.doc_id for r in corpus.likely_in(docs, ids, "doc_id").collect()}
    assert got >= set(range(0, 20_000, 50)) and len(got) < 450
    monkeypatch.setattr(corpus, "ID_WORDS", 1)  # a full map lets everything pass, and still loses nothing
    assert {r.doc_id for r in corpus.likely_in(docs, ids, "doc_id").collect()} >= set(range(0, 20_000, 50))


def held_out_rows(spark, name, label):
    rows = QUERIES[name](spark, D).collect()
    docs = {r.doc_id for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id").collect()}
    assert {r.doc_id for r in rows} == docs and len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    return [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]


def test_toxicity_query_on_held_out_rows(spark):
    pairs = held_out_rows(spark, "op3_toxicity", "toxic")
    assert sum(p == t for p, t in pairs) >= 0.9 * len(pairs) and sum(p for p, t in pairs if not t) <= 0.03 * len(pairs)
    caught, toxic = sum(p for p, t in pairs if t), sum(t for _, t in pairs)
    print(f"toxic documents caught: {caught} of {toxic}")
    assert caught >= 0.6 * toxic


def test_quality_query_on_held_out_rows(spark):
    pairs = held_out_rows(spark, "op6_quality", "quality")
    assert sum(p == t for p, t in pairs) >= 0.95 * len(pairs)
