"""Threshold-scaled sketches and the comparison with neighbours."""

import hashlib
import random

import pytest

from sysloom.llm import sketch as sk
from sysloom.llm.queries import QUERIES


def text(rnd, n):
    return " ".join(f"word{rnd.randrange(900)}" for _ in range(n))


def shingles(t):
    return {t[k:k + sk.SHINGLE_BYTES] for k in range(len(t) - sk.SHINGLE_BYTES + 1)}


def test_containment_is_estimated_for_unequal_texts():
    rnd = random.Random(1)
    large = text(rnd, 20_000)
    small = large[5000:9000] + text(rnd, 600)
    a, b = small.encode(), large.encode()
    true = len(shingles(a) & shingles(b)) / len(shingles(a))
    assert sk.likeness(sk.sketch(a), sk.sketch(b)) == pytest.approx(true, abs=0.15)
    assert sk.likeness(sk.sketch(b), sk.sketch(b)) == 1


def test_sketch_keeps_all_below_the_fraction_and_merges():
    rnd = random.Random(2)
    a, b = text(rnd, 5000).encode(), text(rnd, 3000).encode()
    limit, kept = sk.sketch(a)
    every = {int(h) for h in sk.shingle_hashes(a)}
    assert set(kept.tolist()) == {h for h in every if h <= limit}
    union = every | {int(h) for h in sk.shingle_hashes(b)}
    merged = sk.merge(sk.sketch(a), sk.sketch(b))
    assert set(merged[1].tolist()) == {h for h in union if h <= merged[0]}
    back = sk.from_string(sk.to_string((limit, kept)))
    assert back[0] == limit and back[1].tolist() == kept.tolist()


def test_short_and_empty_texts():
    assert sk.likeness(sk.sketch(b""), sk.sketch(b"")) == 1
    assert sk.likeness(sk.sketch(b""), sk.sketch(b"a", 1.0)) == sk.likeness(sk.sketch(b"a", 1.0), sk.sketch(b"")) == 0
    # one fraction for texts of all sizes
    assert sk.sketch(b"a")[0] == sk.sketch(b"abcdefgh" * 4000)[0] and len(sk.sketch(b"a", 1.0)[1]) == 1
    assert sk.likeness(sk.sketch(b"a", 1.0), sk.sketch(b"b", 1.0)) == 0


def test_estimates_are_near_the_truth_on_average():
    rnd, off = random.Random(6), []
    for _ in range(150):
        a = text(rnd, rnd.randrange(150, 900))
        b = a[:len(a) // rnd.choice((1, 2, 4))] + text(rnd, 200)
        true = len(shingles(a) & shingles(b)) / len(shingles(a))
        off.append(abs(sk.likeness(sk.sketch(a.encode()), sk.sketch(b.encode())) - true))
    assert sum(off) / len(off) < 0.04 and max(off) < 0.25


def test_slices_do_not_matter(monkeypatch):
    t = text(random.Random(3), 900).encode()
    whole = sk.to_string(sk.sketch(t))
    monkeypatch.setattr(sk, "_SLICE", 100)
    assert sk.to_string(sk.sketch(t)) == whole


def expected(rows):
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        s, e, n = (sk.sketch(x.encode()) for x in (t, edited, after))
        out.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), sk.to_string(s), sk.to_string(e), sk.likeness(s, e), sk.likeness(s, n)))
    return sorted(out)


def listed(df):
    return sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in df.collect())


def test_neighbours_of_all_kinds(spark):
    rnd = random.Random(4)
    rows = [(i * i - 50, rnd.choice(["", "é", text(rnd, rnd.randrange(1, 80)), "same text " * 9])) for i in range(60)]
    rows += [(7, "first"), (7, "second"), (7, "first"), (10**12, "ñ" * 5000), (None, "no id"), (None, "also none")]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    shuffled = rnd.sample(rows, len(rows))
    docs = spark.createDataFrame([(i, t if t else None, "x") for i, t in shuffled], "doc_id long, text string, fingerprint string")
    assert listed(sk.against_neighbours(docs)) == expected(rows)
    one = docs.filter("doc_id = 1000000000000")
    assert listed(sk.against_neighbours(one)) == expected([(10**12, "ñ" * 5000)])
    assert sk.against_neighbours(docs.limit(0)).count() == 0 and sk.fingerprints(docs).count() == len(rows)


def test_text_ids_follow_their_order(spark):
    rnd = random.Random(5)
    rows = sorted([(f"id-{rnd.randrange(1000)}", text(rnd, 30)) for _ in range(40)] + [("a", "")])
    docs = spark.createDataFrame(rnd.sample([*rows, (None, "z")], len(rows) + 1), "doc_id string, text string")
    assert listed(sk.against_neighbours(docs)) == expected([*rows, (None, "z")])


def test_query_against_plain_code(spark):
    d = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{d}/documents.parquet").collect())
    assert listed(QUERIES["op9_sketch"](spark, d)) == expected(rows)
