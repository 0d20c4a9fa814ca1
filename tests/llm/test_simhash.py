"""SimHash fingerprints and components against brute force."""

import random

import pytest
import xxhash

from sysloom.llm import simhash
from sysloom.llm.components import components
from sysloom.llm.queries import QUERIES

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def plain_fingerprint(text, size=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\r\x0b\x0c":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    runs = [" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(fps, max_bits=4):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    keys = list(root)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= max_bits:
                root[find(a)] = find(b)
    return {f: find(f) for f in keys}


def expected(rows):
    fps = {k: plain_fingerprint(t) for k, (_, t) in enumerate(rows)}
    comp = plain_components(set(fps.values()))
    ids = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            ids[comp[fps[k]]] = min(ids.get(comp[fps[k]], i), i)
    return sorted((i is None, i, f"{fps[k]:016x}", ids.get(comp[fps[k]])) for k, (i, _) in enumerate(rows))


def test_texts_of_all_kinds(spark):
    rnd = random.Random(3)
    base = [rnd.choice(WORDS) for _ in range(400)]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "ONE"), (5, "Été à l'ÉCOLE"), (None, "one"), (7, "one"), (7, "one")]
    for i in range(20, 60):
        edited = list(base)
        for _ in range(rnd.randrange(4)):
            edited[rnd.randrange(400)] = rnd.choice(WORDS)
        rows.append((i, rnd.choice([" ", "\n", "  "]).join(edited)))
    rows.append((99, " ".join(rnd.choice(WORDS) for _ in range(70_000))))
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, fp string, component_id string")
    got = sorted((r.doc_id is None, r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert [str(x) for x in got] == [str(x) for x in expected(rows)]
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(
        i for _, i, _, c in expected(rows) if i is not None and i == c)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_first(empty).count() == 0


@pytest.mark.parametrize("parts", [4096, 16])
def test_links_connect_what_is_near(spark, monkeypatch, parts):
    """Also with cells that must be split into parts."""
    monkeypatch.setattr(simhash, "CELL_MEMBERS", parts)
    rnd = random.Random(5)
    fps = {rnd.getrandbits(64) for _ in range(150)}
    for _ in range(250):
        fps.add(rnd.choice(sorted(fps)) ^ sum({1 << rnd.randrange(64) for _ in range(rnd.randrange(1, 6))}))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    pairs = [(r.a, r.b) for r in found.collect()]
    assert all(0 < ((a ^ b) & (1 << 64) - 1).bit_count() <= 4 for a, b in pairs)
    want = plain_components(fps)
    roots = {r.node: r.root for r in components(found, "a", "b").collect()}
    groups = {}
    for f, s in zip(fps, signed):
        groups.setdefault(want[f], set()).add(roots.get(s, s))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_manhattan_is_a_lower_bound(spark):
    from pyspark.sql import functions as F
    rnd = random.Random(7)
    pairs = [tuple(rnd.getrandbits(64) - (1 << 63) for _ in range(2)) for _ in range(200)]
    df = spark.createDataFrame(pairs, "a long, b long")
    e = simhash.embedding
    rows = df.select("a", "b", simhash.manhattan(e(F.col("a")), e(F.col("b"))).alias("low")).collect()
    for r in rows:
        count = lambda x: [((x >> k) & 3).bit_count() for k in range(0, 64, 2)]
        u, v = r.a & (1 << 64) - 1, r.b & (1 << 64) - 1
        assert r.low == sum(abs(p - q) for p, q in zip(count(u), count(v))) <= (u ^ v).bit_count()


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in QUERIES["op8_simhash"](spark, d).collect())
    assert got == [x[1:] for x in expected(rows)]
