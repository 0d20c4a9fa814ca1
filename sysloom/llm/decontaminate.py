"""Benchmark decontamination with spaced seeds, in DataFrame functions alone.

A seed hashes the words at the set positions of a mask and ignores the others, so it still
matches where a word between them was replaced.  The three masks together miss about one in
two hundred of the patterns with a fifth of 12 to 20 words replaced, and hardly any in longer
passages.  Seeds of all document positions meet the seeds of the benchmark in a broadcast
join; a hit lays the passage over the document, and the overlap is verified word by word: a
document leaks an item if ``window`` aligned words (all of a shorter passage) agree in
``similarity`` of the positions.

Items under ``SHORT_WORDS`` words are shorter than two masks laid side by side and get masks of
their own, down to a single word.  Those miss nothing: an item in which e words may differ is cut
into e + 2 blocks, and each mask has all but e of the blocks, so one of them is left whole by
any e words.  Documents are hashed under these masks only if the benchmark has such items.

The benchmark is a stated query set of any size: its seeds are counted, and each pass over
the documents broadcasts a share of at most about ``BLOCK_SEEDS`` of them.  The texts are
hashed once per pass and never shuffled; only verified overlaps are, one row per document,
passage and offset after map-side grouping.

Words are runs of letters and digits in lower case.  Null and empty texts and items have no
seed, and empty tables give an empty result.  Very long texts are one row of hashes.  Rows of a
repeated document id are one document.  Documents without an id are reported together under a
null id; ``drop_leaks`` judges each of them by its own text.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed masks: 1 is a position that must agree.
MASKS = ("1110111", "111001011", "100011111")
#: Items with fewer words than this have masks of their own.
SHORT_WORDS = 12
#: Items are cut into passages of this many words, each half overlapping the next.
PASSAGE_WORDS = 256
BLOCK_SEEDS = 1_000_000
_PATTERN = r"[^\p{L}\p{N}]+"


def _words(text: str) -> Column:
    return F.split(F.lower(F.col(text)), _PATTERN)


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _seed(number: int, mask: str, hashes: str, at: Column) -> Column:
    """Hash under one mask at position ``at``; null where the mask runs over the end."""
    picked = [F.get(F.col(hashes), at + i) for i, bit in enumerate(mask) if bit == "1"]
    return F.when(picked[-1].isNotNull(), F.xxhash64(F.lit(number), *picked))


def _seeds(hashes: str, at: str, masks: Sequence[str] = MASKS) -> Column:
    return F.array(*[_seed(k, mask, hashes, F.col(at)) for k, mask in enumerate(masks)])


def _positions(hashes: str, masks: Sequence[str] = MASKS) -> Column:
    """0 up to the last position of the shortest mask."""
    last = F.size(hashes) - min(map(len, masks))
    return F.when(last >= 0, F.sequence(F.lit(0), last))


def short_masks(words: int, similarity: float) -> list[tuple[int, str]]:
    """(offset, mask) for an overlap of few words; whichever words differ, one mask agrees."""
    wrong = max(e for e in range(words) if (words - e) / words >= similarity)
    blocks = min(words, wrong + 2) if wrong else 1
    out = []
    for gone in combinations(range(blocks), wrong):
        bits = "".join("0" if k * blocks // words in gone else "1" for k in range(words))
        out.append((bits.index("1"), bits.strip("0")))
    return out


def masks_of(cut: DataFrame, window: int, similarity: float) -> tuple[dict[int, list[tuple[int, str]]], list[str]]:
    """Masks of the short overlaps that occur, by their words, and all masks in use."""
    found = cut.filter(f"n between 1 and {SHORT_WORDS - 1}").select(F.least("n", F.lit(window)).alias("w")).distinct().collect()
    short = {r.w: short_masks(r.w, similarity) for r in found}
    return short, [*MASKS, *sorted({mask for masks in short.values() for _, mask in masks} - set(MASKS))]


def passages(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, passage, words, n): hashed words of each item in overlapping passages."""
    words = F.filter(_words(text_col), lambda w: w != "")
    items = benchmark.select(F.col(id_col).alias("item_id"), _hashes(words).alias("all")).filter("all is not null").distinct()
    half = PASSAGE_WORDS // 2
    last = F.greatest(F.ceil((F.size("all") - PASSAGE_WORDS) / half), F.lit(0))
    cut = items.select("item_id", "all", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part"))
    cut = cut.select("item_id", F.slice("all", (F.col("part") * half + 1).cast("int"), PASSAGE_WORDS).alias("words"))
    return cut.select("item_id", F.xxhash64("item_id", "words").alias("passage"), "words", F.size("words").alias("n"))


def passage_seeds(cut: DataFrame, short: dict[int, list[tuple[int, str]]], masks: list[str], window: int) -> DataFrame:
    placed = cut.filter(f"n >= {SHORT_WORDS}").select("passage", "n", "words", F.explode(_positions("words")).alias("offset"))
    seeds = placed.select("passage", "n", "offset", F.explode(_seeds("words", "offset")).alias("seed"))
    if short:
        width = F.least("n", F.lit(window))
        few = cut.filter(f"n between 1 and {SHORT_WORDS - 1}").select(
            "passage", "n", "words", width.alias("width"), F.explode(F.sequence(F.lit(0), F.col("n") - width)).alias("start"))
        pairs = [F.when(F.col("width") == w, F.struct(
            (F.col("start") + o).alias("offset"), _seed(masks.index(m), m, "words", F.col("start") + o).alias("seed")))
            for w, own in sorted(short.items()) for o, m in own]
        seeds = seeds.unionByName(few.select("passage", "n", F.explode(F.array(*pairs)).alias("p")).select("passage", "n", "p.offset", "p.seed"))
    return seeds.filter("seed is not null").distinct()


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
    item_text_col: str = "text", window: int = 20, similarity: float = 0.8,
) -> DataFrame:
    """(id, item_id, overlap, matched_words): documents with a verified overlap, by item.

    ``overlap`` is the greatest share of agreeing words in an aligned window, and
    ``matched_words`` the most words that agree in one alignment.
    """
    cut = passages(benchmark, item_id_col, item_text_col)
    short, masks = masks_of(cut, window, similarity)
    seeds_of = lambda part: passage_seeds(part, short, masks, window)
    blocks = max(1, math.ceil(seeds_of(cut).count() / BLOCK_SEEDS))
    rows = docs.select(F.col(id_col).alias("id"), _hashes(_words(text_col)).alias("own"))
    # an outer generator: nothing is inferred from it that would hash the texts again below
    placed = rows.select("id", "own", F.explode_outer(_positions("own", masks)).alias("at"))
    placed = placed.select("id", "own", "at", F.explode(_seeds("own", "at", masks)).alias("seed"))
    found = None
    for k in range(blocks):
        share = cut.filter(F.pmod(F.col("passage"), F.lit(blocks)) == k)
        part = _block(placed, share, seeds_of(share), window, similarity)
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("id", "item_id").agg(F.max("overlap").alias("overlap"), F.max("matched_words").alias("matched_words"))
    return best.withColumnsRenamed({"id": id_col, "item_id": item_id_col})


def _block(placed: DataFrame, cut: DataFrame, seeds: DataFrame, window: int, similarity: float) -> DataFrame:
    hits = placed.join(F.broadcast(seeds), "seed")  # size: BLOCK_SEEDS
    begin = F.greatest(F.col("at") - F.col("offset"), F.lit(0))
    end = F.least(F.col("at") - F.col("offset") + F.col("n"), F.size("own"))
    hits = hits.select("id", "passage", (F.col("at") - F.col("offset")).alias("shift"), F.slice("own", begin + 1, end - begin).alias("own"))
    # all hits of one alignment carry the same words
    aligned = hits.groupBy("id", "passage", "shift", F.xxhash64("own").alias("_words")).agg(F.first("own").alias("own"))
    both = aligned.join(F.broadcast(cut), "passage")  # no more words than twelve times the seeds
    lead = F.greatest(-F.col("shift"), F.lit(0))
    same = F.zip_with("own", F.slice("words", lead + 1, F.size("own")), lambda a, b: F.when(a == b, 1).otherwise(0))
    both = both.select("id", "item_id", same.alias("same"), F.least("n", F.lit(window)).alias("width"))
    sums = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("same") - F.col("width"), F.lit(0))),
        lambda i: F.aggregate(F.slice("same", i + 1, F.col("width")), F.lit(0), lambda s, x: s + x))
    scored = both.select(
        "id", "item_id", (F.array_max(sums) / F.col("width")).alias("overlap"),
        F.aggregate("same", F.lit(0), lambda s, x: s + x).cast("long").alias("matched_words"))
    return scored.filter(F.col("overlap") >= similarity)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that leak a benchmark item."""
    key = F.struct(F.col(id_col).alias("id"), F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).alias("text"))
    found = leaks(docs.select(key.alias("key"), F.col(text_col).alias("text")), benchmark, "key", "text", **options)
    gone = found.select(F.col("key").alias("_leaked")).distinct()
    own = F.struct(docs[id_col].alias("id"), F.when(docs[id_col].isNull(), F.xxhash64(docs[text_col])).alias("text"))
    return docs.join(gone, own == gone["_leaked"], "left_anti")


#: The same result by another engine, from the words themselves instead of their hashes; short
#: items are laid over every position without a mask.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT DISTINCT item_id, [x FOR x IN regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') IF x <> ''] AS w FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT item_id, list_slice(w, part * 128 + 1, part * 128 + 256) AS w FROM
  (SELECT item_id, w, unnest(range(0, 1 + greatest(CAST(ceil((len(w) - 256) / 128.0) AS BIGINT), 0))) AS part FROM i)),
pn AS (SELECT row_number() OVER () AS passage, item_id, w FROM p),
m AS (SELECT * FROM (VALUES (0, [0,1,2,4,5,6]), (1, [0,1,2,5,7,8]), (2, [0,4,5,6,7,8])) AS t(mask, places)),
ps AS (SELECT passage, pos AS o, mask, [w[pos + x + 1] FOR x IN places] AS seed FROM
  (SELECT passage, w, unnest(range(0, len(w))) AS pos FROM pn WHERE len(w) >= 12), m WHERE pos + places[6] < len(w)),
ds AS (SELECT doc_id, pos, mask, [w[pos + x + 1] FOR x IN places] AS seed FROM
  (SELECT doc_id, w, unnest(range(0, len(w))) AS pos FROM d), m WHERE pos + places[6] < len(w)),
h AS (SELECT doc_id, passage, pos - o AS shift FROM ds JOIN ps USING (mask, seed) UNION
  SELECT doc_id, passage, unnest(range(1 - len(pn.w), len(d.w))) AS shift FROM d, pn WHERE len(pn.w) BETWEEN 1 AND 11),
a AS (SELECT doc_id, item_id, least(len(pn.w), 20) AS width,
  [CAST(d.w[x + 1] = pn.w[x - shift + 1] AS BIGINT) FOR x IN range(greatest(shift, 0), least(shift + len(pn.w), len(d.w)))] AS same
  FROM h JOIN d USING (doc_id) JOIN pn USING (passage)),
s AS (SELECT doc_id, item_id, CAST(list_sum(same) AS BIGINT) AS matched,
  CAST(list_max([list_sum(list_slice(same, k + 1, k + width)) FOR k IN range(0, greatest(len(same) - width, 0) + 1)]) AS DOUBLE) / width AS overlap FROM a)
SELECT doc_id, item_id, max(overlap) AS overlap, max(matched) AS matched_words FROM s WHERE overlap >= 0.8 GROUP BY doc_id, item_id
"""
