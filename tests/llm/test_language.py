"""Sums over segmentations against enumeration, and held-out accuracy."""

import itertools
import random
import zlib

import numpy as np
import pytest

from sysloom.llm import language as lid
from sysloom.llm.queries import QUERIES, vocabulary

PIECES = ["▁", "▁a", "a", "b", "ab", "ba", "aba", "▁ab", "c", "é"]


def segmentations(word):
    text = "▁" + word
    for cuts in itertools.product([0, 1], repeat=len(text) - 1):
        at = [0, *[k + 1 for k, c in enumerate(cuts) if c], len(text)]
        yield [text[i:j] for i, j in zip(at, at[1:])]


def likelihood(word, p):
    chance = lambda x: p.get(x, lid._UNKNOWN_LETTER if len(x) == 1 else 0)
    return sum(np.prod([chance(x) for x in s]) for s in segmentations(word))


def model_of(rnd):
    table = np.array([[rnd.random() for _ in range(3)] for _ in PIECES] + [[0] * 3, [lid._UNKNOWN_LETTER] * 3])
    return table, [{p: table[k, j] for k, p in enumerate(PIECES)} for j in range(3)]


def test_forward_pass_sums_all_segmentations():
    rnd = random.Random(1)
    table, plain = model_of(rnd)
    words = ["a", "ab", "abab", "zab", "caféab", "zz", "babacab", "é"]
    scores = lid.word_scores(np.array(words, object), lid.Pieces(PIECES), table)
    for word, row in zip(words, scores):
        assert row == pytest.approx([np.log(likelihood(word, p)) for p in plain])


def test_long_words_do_not_underflow():
    table, _ = model_of(random.Random(2))
    scores = lid.word_scores(np.array(["ab" * 3000, "zz" * 300, "a"], object), lid.Pieces(PIECES), table)
    assert np.isfinite(scores).all() and (scores[1] < -5000).all()


def test_expected_uses_match_enumeration():
    table, plain = model_of(random.Random(3))
    words, counts = ["ab", "abab", "zab", "a"], np.array([2.0, 1, 3, 5])
    got = lid.expected_uses(np.array(words, object), counts, lid.Pieces(PIECES), table[:, 0])
    want, p = dict.fromkeys(PIECES, 0.0), plain[0]
    for word, n in zip(words, counts):
        total = likelihood(word, p)
        for s in segmentations(word):
            share = np.prod([p.get(x, lid._UNKNOWN_LETTER if len(x) == 1 else 0) for x in s]) / total
            for x in s:
                if x in want:
                    want[x] += n * share
    assert got[:len(PIECES)] == pytest.approx([want[x] for x in PIECES])


def test_pieces_are_found_by_hash():
    vocabulary_ = lid.load_pieces(vocabulary("piece_bpe_32k.model"))
    pieces = lid.Pieces(vocabulary_)
    assert len(set(pieces.hashes.tolist())) == len(vocabulary_) + 1
    assert (pieces.find(pieces.hashes[:-1]) == np.arange(len(vocabulary_))).all()
    assert (pieces.find(np.arange(1, 1000, dtype=np.uint64)) == len(vocabulary_)).sum() > 700


def test_texts_of_all_kinds(spark):
    en, de = "the thing and the other of that", "der und die das nicht ein schön"
    rows = [(i, t * 5, lang) for i in range(30) for t, lang in ((en, "en"), (de, "de"))] + [(100, None, "en"), (101, "", "de"), (102, "12 ²³ ?!", None), (103, de * 3000, None), (103, de * 3000, None), (None, en, "xx"), (104, "x" * 9000, None)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, lang string, score int")
    got = [(r.doc_id, r.lang_pred, r.score) for r in lid.identify(docs, vocabulary("piece_bpe_32k.model")).collect()]
    assert len(got) == len(rows)
    by_id = {i: (p, s) for i, p, s in got}
    assert by_id[100] == by_id[101] == by_id[102] == ("und", 0.0) and by_id[103][0] == "de" and by_id[None][0] == "en" and by_id[104][0] in ("en", "de")
    assert all(0 <= s <= 1 for _, _, s in got)
    nothing = spark.createDataFrame([(1, "word", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in lid.identify(nothing, vocabulary("piece_bpe_32k.model")).collect()] == ["und"]
    assert lid.identify(nothing.limit(0), vocabulary("piece_bpe_32k.model")).count() == 0


def test_query_on_held_out_documents(spark):
    rows = QUERIES["op2_language"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and r.lang]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)


def test_copies_of_a_text_do_not_break_the_bound_of_the_sample(spark, monkeypatch):
    rows = [(i, "the same words again", "en") for i in range(1000)]
    docs, fitted, count = spark.createDataFrame(rows, "doc_id long, text string, lang string"), [], lid._word_counts
    monkeypatch.setattr(lid, "_word_counts", lambda sample: fitted.append(sample.count()) or count(sample))
    lid.identify(docs, vocabulary("piece_bpe_32k.model"), max_docs=100)
    assert 50 <= fitted[0] <= 150
