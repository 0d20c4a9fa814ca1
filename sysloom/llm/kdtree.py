"""K-d tree sharding in DataFrame functions alone.

A point is a distinct text with the bytes of all its copies as weight, so copies share a
shard; only a text whose copies outweigh a whole shard is cut, by document, into pieces of
about ``PIECE`` of one.  The tree starts with all points and the number of shards.  Each level
takes, for every cell that holds more than one shard, the dimension in which the cell is widest
and cuts it there at the weighted median (for an odd number of shards, at the matching quantile).
Medians come from histograms: grouped sums with map-side partials, zoomed into the bin that
holds the cut until it is one point or lighter than ``TOLERANCE`` of a shard.  Ties
in a dimension are ordered by the point's hash, so many equal values can still be cut.  The
driver sees a row per cell, never a point.

A heavy point at the cut would leave the lower half short of its share.  What is missing is then
filled with the nearest points above the cut that are light enough, by the same histograms over
those points alone, and so on until it is below ``TOLERANCE`` of a shard or no point fits.

Sizes are UTF-8 bytes plus ``ROW_BYTES``; the law is ``bytes``: shard sizes are near equal.
Within a shard, slots are dealt in blocks of ids and numbered from block counts, without a
sort of the whole shard.

Rows: a null text has no bytes and is a point like any other; null metadata count as zero.
Repeated rows have a slot each.  An empty table gives an empty result.  Columns that the
result names replace those of the input; others are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, release

ROW_BYTES = 16
PIECE = 0.02
TOLERANCE = 0.002
BINS = 1024
#: Rows that one block of a shard holds on average.
BLOCK_ROWS = 50_000
_HASH_BITS = 31


# position in the cell's dimension, ties by hash: one sortable number
_KEY = f"shiftleft(cast(element_at(place, dimension + 1) AS bigint), {_HASH_BITS}) | h"


def _cells(points: DataFrame, rows: list[tuple], schema: str, how: str = "inner") -> DataFrame:
    """Points with what the driver knows of their cell; there are fewer cells than shards."""
    return points.join(F.broadcast(points.sparkSession.createDataFrame(rows, f"cell int, dimension int, {schema}")), "cell", how)


def grow(points: DataFrame, dimensions: int, shards: int) -> DataFrame:
    """``points`` (place: array of positions, h, weight) with ``cell``, the shard that each falls into.

    A cell bears the number of its first shard; ``spread`` has how many it holds.
    """
    points = cut_lineage(points.withColumn("cell", F.lit(0)))
    spread, total = ({0: shards} if shards > 1 else {}), None
    while spread:
        within = points.filter(F.col("cell").isin(list(spread)))
        ranges = [x for k in range(dimensions) for x in (F.min(F.get("place", F.lit(k))).alias(f"a{k}"), F.max(F.get("place", F.lit(k))).alias(f"b{k}"))]
        found = {r.cell: r for r in within.groupBy("cell").agg(F.sum("weight").alias("weight"), *ranges).collect()}
        if total is None:
            total = sum(r.weight for r in found.values())
        small = TOLERANCE * total / shards
        # a point goes to the lower half if it is no heavier than ``limit`` and lies below ``cut``, for one rule of its cell
        rules, live, ends, place = {cell: [] for cell in found}, {}, {}, {}
        for cell, r in found.items():
            place[cell] = max(range(dimensions), key=lambda k: (r[f"b{k}"] - r[f"a{k}"], -k))
            start, ends[cell] = r[f"a{place[cell]}"] << _HASH_BITS, (r[f"b{place[cell]}"] + 1) << _HASH_BITS
            # the cut lies in the bins from start on; ``under`` is the weight before them
            live[cell] = (start, _step(start, ends[cell]), r.weight * (spread[cell] // 2) / spread[cell], 0.0, math.inf)
        while live:
            rows = [(cell, place[cell], *state) for cell, state in live.items()]
            bins = _cells(within, rows, "start long, step long, goal double, under double, limit double").filter("weight <= limit").selectExpr(
                "cell", "goal", "under", "weight", f"({_KEY}) - start AS over", "step").filter("over >= 0")
            bins = bins.selectExpr("cell", "goal", "under", "weight", "over", "over div step AS bin").filter(F.col("bin") < BINS)
            sums = bins.groupBy("cell", "goal", "under", "bin").agg(F.sum("weight").alias("weight"), (F.min("over") == F.max("over")).alias("single"))
            sums = sums.selectExpr("*", "under + sum(weight) OVER (PARTITION BY cell ORDER BY bin) AS upto").filter("upto >= goal")
            reached = {r.cell: r.at for r in sums.groupBy("cell").agg(F.min(F.struct("bin", "weight", "upto", "single")).alias("at")).collect()}
            following = {}
            for cell, (start, step, goal, _, limit) in live.items():
                at = reached.get(cell)
                if at is None:  # all that are light enough go to the lower half
                    rules[cell].append((limit, ends[cell]))
                    continue
                edge, under = start + at.bin * step, at.upto - at.weight
                if at.weight <= small:
                    rules[cell].append((limit, edge + step if at.upto - goal <= goal - under else edge))
                elif not at.single and step > 1:
                    following[cell] = (edge, max(1, -(-step // BINS)), goal, under, limit)
                elif at.upto - goal <= small:
                    rules[cell].append((limit, edge + step))
                else:
                    rules[cell].append((limit, edge))
                    if goal - under > small:
                        following[cell] = (edge, _step(edge, ends[cell]), goal - under, 0.0, goal - under)
            live = following
        rows = [(cell, place[cell], found, cell + spread[cell] // 2) for cell, found in rules.items()]
        moved = points
        if rows:
            lower = f"exists(rules, r -> weight <= r.limit AND ({_KEY}) < r.cut)"
            moved = _cells(points, rows, "rules array<struct<limit: double, cut: bigint>>, upper int", "left").selectExpr(
                *[c for c in points.columns if c != "cell"], f"if(rules IS NULL OR {lower}, cell, upper) AS cell")
        moved = cut_lineage(moved)
        release(points)
        points = moved
        halves = [x for cell, n in spread.items() for x in ((cell, n // 2), (cell + n // 2, n - n // 2))]
        spread = {cell: n for cell, n in halves if n > 1}
    return points


def _step(start: int, end: int) -> int:
    return max(1, -(-(end - start) // BINS))


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of each row."""
    text = F.col(text_col)
    short_hash = lambda c, bits: F.shiftrightunsigned(F.xxhash64(c), 64 - bits)
    rows = cut_lineage(docs.select(
        F.col(id_col).alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"), F.xxhash64(text).alias("t"), F.xxhash64(F.lit(1), text).alias("u"),
        # the metadata dimensions: length on a logarithmic scale, source, language; length is the narrowest and runs
        # from long to short, so that the points above a cut are light enough to even it out
        (F.lit(512) - F.floor(F.log2(F.coalesce(F.length(text), F.lit(0)) + F.lit(1.0)) * 16)).cast("int").alias("m0"),
        F.when(F.col(source_col).isNull(), 0).otherwise(short_hash(source_col, 19)).cast("int").alias("m1"),
        F.when(F.col(lang_col).isNull(), 0).otherwise(short_hash(lang_col, 18)).cast("int").alias("m2")))
    total = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).first()
    goal = max(1.0, (total["bytes"] or 0) / shards)
    texts = rows.groupBy("t", "u").agg(F.sum("size").alias("weight"), F.count("*").alias("n"), F.array(F.min("m0"), F.min("m1"), F.min("m2")).alias("place"))
    texts = cut_lineage(texts.withColumn("pieces", F.when(F.col("weight") <= goal, 1).otherwise(F.least(F.ceil(F.col("weight") / (PIECE * goal)), "n")).cast("int")))
    # texts of several pieces: fewer than shards, as each outweighs one
    heavy = F.broadcast(texts.filter("pieces > 1").select("t", "u", "pieces"))
    pieced = rows.join(heavy, ["t", "u"], "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64("id", "crc"), F.col("pieces")), F.lit(0)).cast("int"))
    parts = pieced.filter("pieces is not null").groupBy("t", "u", "piece").agg(F.sum("size").alias("weight"))
    whole = texts.filter("pieces = 1").select("t", "u", F.lit(0).alias("piece"), "place", "weight")
    cut = parts.join(F.broadcast(texts.filter("pieces > 1").select("t", "u", "place")), ["t", "u"]).select("t", "u", "piece", "place", "weight")
    points = whole.unionByName(cut).withColumn("h", F.shiftrightunsigned(F.xxhash64("t", "u", "piece"), 64 - _HASH_BITS))
    points = grow(points.withColumn("weight", F.col("weight").cast("double")), 3, shards)

    placed = pieced
    blocks = max(1, -(-(total["rows"] or 0) // (shards * BLOCK_ROWS)))
    block = F.pmod(F.xxhash64(F.lit(7), "id", "crc"), F.lit(blocks)).cast("int")
    placed = cut_lineage(placed.join(points.select("t", "u", "piece", "cell"), ["t", "u", "piece"]).select(
        "id", "size", "crc", F.col("cell").alias("shard"), block.alias("block")))
    release(rows, texts, points)
    counts = placed.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = counts.selectExpr("shard", "block", "sum(n) OVER (PARTITION BY shard ORDER BY block) - n AS before")
    slots = placed.withColumn("at", F.expr("row_number() OVER (PARTITION BY shard, block ORDER BY id, crc) - 1")).join(before, ["shard", "block"])
    return slots.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("at") + F.col("before")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
