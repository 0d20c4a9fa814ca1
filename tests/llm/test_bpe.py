"""The transducer against the tokenizer file's own library."""

import hashlib
import random

import pytest
from tokenizers import Tokenizer

from sysloom.llm import bpe
from sysloom.llm.queries import QUERIES, vocabulary

PATH = vocabulary("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def ours():
    with open(PATH) as f:
        return bpe.Bpe(f.read())


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def ids(coder, text):
    return [i for part in coder.encode(text) for i in part]


def test_lookahead_of_a_small_merge_list():
    assert bpe.sufficient_lookahead([(b"a", b"b")]) == 1
    # a change at the right end can move on through ab|c, then x|ab
    assert bpe.sufficient_lookahead([(b"b", b"c"), (b"a", b"b"), (b"x", b"a")]) == 3
    assert bpe.sufficient_lookahead([]) == 0


def test_random_texts(ours, library):
    rnd = random.Random(1)
    for alphabet in ("ab cdeéñ'stre\n\t12 ", "   \n", "日本語 текст😀́", "'s't're've", "<|endoftext|> "):
        for _ in range(60):
            text = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(300)))
            if rnd.random() < 0.3:
                text += "<|endoftext|>" + text
            assert ids(ours, text) == library.encode(text, add_special_tokens=False).ids
            assert "".join(ours.decode(ours.encode(text))) == text


def test_long_runs_go_through_the_window(ours, library, monkeypatch):
    rnd = random.Random(2)
    for alphabet in ("abcdefghij", "ab", "the", "A", "=-", "éß"):
        text = "".join(rnd.choice(alphabet) for _ in range(6000))
        run, want = text.encode(), library.encode(text, add_special_tokens=False).ids
        assert len(run) > ours.window and ids(ours, text) == want
        assert list(ours.stream([run[k:k + 7] for k in range(0, len(run), 7)])) == want
    monkeypatch.setattr(bpe, "SLICE", 50)
    text = " ".join("".join(rnd.choice("abc,. \n") for _ in range(rnd.randrange(9))) for _ in range(900))
    assert ids(ours, text) == library.encode(text, add_special_tokens=False).ids


def test_decoder_holds_back_unfinished_characters(ours, library):
    text = "é😀日"
    every = ids(ours, text)
    assert "".join(ours.decode([i] for i in every)) == text
    broken = [ours.single[b] for b in (0xF0, 0x9F, 0x41, 0xFF, 0xC3)]
    assert "".join(ours.decode([i] for i in broken)) == library.decode(broken, skip_special_tokens=False)


def test_tables_of_all_kinds(spark):
    data = [(1, "a b"), (2, None), (3, ""), (None, "x" * 50_000), (1, "a b")]
    docs = spark.createDataFrame([(*r, 5) for r in data], "doc_id long, text string, n_tokens int")
    tokens = bpe.token_ids(docs, PATH)
    assert sorted(len(r.token_ids) for r in tokens.collect())[:3] == [0, 0, 2]
    back = bpe.texts_of(tokens, PATH)
    assert sorted(r.text for r in back.collect()) == sorted(t or "" for _, t in data)
    rows = bpe.round_trip(docs, PATH).collect()
    assert sorted(r.n_tokens for r in rows)[:4] == [0, 0, 2, 2] and len(rows) == 5
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0


def test_query_against_the_library(spark, library):
    d = "/root/testdata/sf0.001"
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        e = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (len(e), sha(",".join(map(str, e))), sha(library.decode(e, skip_special_tokens=False)))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op7_bpe"](spark, d).collect()} == want
