"""SimHash near-duplicates found through a segment-popcount embedding.

A 64-bit fingerprint is embedded as the bit counts of its 32 two-bit segments.  Flipping a
bit moves one count by at most one, so the Manhattan distance of two embeddings is a lower
bound of the number of differing bits.  The counts are kept in unary (each segment's bits,
sorted), which makes that distance the bit count of an exclusive or.

The grid splits the segments into eight blocks.  At a distance of ``max_bits`` at most that
many blocks differ, so two linked fingerprints share the cell of ``8 - max_bits`` blocks for
at least one choice of blocks.  Cells are joined per choice; pairs are then held against the
Manhattan bound and verified on the fingerprints themselves.

Rows: a null text has no word.  Fingerprints of equal texts are equal, so copies meet in the
first aggregation and the join sees distinct fingerprints only.  A document whose id is null
gets a fingerprint; its component is the smallest id of its group (null if there is none).
An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, release
from .components import components

SEED = 42
BLOCKS = 8
#: Members of a cell that one task compares; larger cells are split into pairs of parts.
CELL_MEMBERS = 4096
_SLICE = 1 << 15


def text_fingerprint(text: bytes, size: int = 4) -> int:
    """Unsigned SimHash of ``text`` over runs of ``size`` words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[:max(1, len(words) - size + 1)], ends[min(size, len(words)) - 1:]
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for k in range(0, len(starts), _SLICE):
        spans = zip(starts[k:k + _SLICE].tolist(), ends[k:k + _SLICE].tolist())
        hashes = np.array([digest(joined[s:e], SEED) for s, e in spans], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """(id, fp): the fingerprint of each whole text as a signed 64-bit number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            out = np.array([text_fingerprint(t.as_py() or b"", size) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def embedding(fp: Column) -> Column:
    """Bit counts of the two-bit segments, in unary."""
    low, high = F.lit(0x5555555555555555), F.lit(-0x5555555555555556)
    one = fp.bitwiseOR(F.shiftrightunsigned(fp, 1)).bitwiseAND(low)
    two = fp.bitwiseAND(F.shiftleft(fp, 1)).bitwiseAND(high)
    return one.bitwiseOR(two)


def manhattan(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _cells(distinct: DataFrame, max_bits: int) -> DataFrame:
    """(choice, cell, fp): one row per fingerprint and choice of blocks."""
    choices = []
    for k, blocks in enumerate(combinations(range(BLOCKS), BLOCKS - max_bits)):
        mask = _signed(sum(0xFF << (8 * b) for b in blocks))
        choices.append(F.struct(F.lit(k).cast("short").alias("choice"), F.lit(mask).alias("mask")))
    rows = distinct.select("fp", embedding(F.col("fp")).alias("e"), F.explode(F.array(*choices)).alias("c"))
    return rows.select("c.choice", F.col("e").bitwiseAND(F.col("c.mask")).alias("cell"), "fp")


def _unary(x: np.ndarray) -> np.ndarray:
    one = np.uint64(1)
    return ((x | (x >> one)) & np.uint64(0x5555555555555555)) | (x & (x << one) & np.uint64(0xAAAAAAAAAAAAAAAA))


def _trees(members: np.ndarray, max_bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that connect what is connected among ``members``: a search outward from each
    fingerprint not yet reached, so dense cells cost little and no pair list is built."""
    left, right, rest = [], [], np.unique(members)
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = np.bitwise_count(_unary(rest) ^ _unary(np.array([x]))) <= max_bits
            near[near] = np.bitwise_count(rest[near] ^ x) <= max_bits
            found, rest = rest[near], rest[~near]
            left.append(np.full(len(found), x))
            right.append(found)
            front.extend(found)
    return left, right


def links(distinct: DataFrame, max_bits: int = 4) -> DataFrame:
    """(a, b): links among distinct fingerprints, enough of them to connect all that are
    at most ``max_bits`` apart, directly or through others.

    Cells with two members give their pair at once.  The members of larger ones are gathered
    in groups of bounded size: a cell above ``CELL_MEMBERS`` is split into parts by hash, and
    each pair of parts is a group, so no pair of members is lost.
    """
    if not 0 <= max_bits < BLOCKS:
        raise ValueError(f"max_bits must be between 0 and {BLOCKS - 1}")
    cells = _cells(distinct, max_bits)
    sizes = cells.groupBy("choice", "cell").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
    sizes = cut_lineage(sizes.filter("n > 1"))
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    bound = manhattan(embedding(F.col("a")), embedding(F.col("b")))
    twos = sizes.filter("n = 2").filter(bound <= max_bits).filter(apart <= max_bits).select("a", "b")

    parts = F.ceil(F.col("n") / CELL_MEMBERS).cast("int")
    more = cells.join(sizes.filter("n > 2").select("choice", "cell", "n"), ["choice", "cell"])
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    more = more.withColumn("parts", parts).withColumn("part", part).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    groups = more.groupBy("choice", "cell", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")).agg(
        F.collect_list("fp").alias("members"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            for members in batch.column(0):
                a, b = _trees(members.values.to_numpy().view(np.uint64), max_bits)
                left += a
                right += b
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x).astype(np.uint64).view(np.int64)) for x in (left, right)], ["a", "b"])

    return twos.unionByName(groups.select("members").mapInArrow(search, "a long, b long")).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, max_bits: int = 4) -> DataFrame:
    """(id, fingerprint, component_id) of each row: the component is the smallest id that
    chains of links reach from it, its own included."""
    rows = cut_lineage(fingerprints(docs, id_col, text_col, size))
    distinct = cut_lineage(rows.groupBy("fp").agg(F.min("id").alias("first")))
    roots = components(links(distinct, max_bits), "a", "b")
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = rooted.join(smallest, "root").select("fp", "component_id")
    return rows.join(labels, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, max_bits: int = 4) -> DataFrame:
    """``docs`` without the documents that a smaller id represents.

    Rows without an id stay, as do repeated rows of a document that stays.
    """
    found = near_duplicates(docs, id_col, text_col, size, max_bits)
    gone = found.filter(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
