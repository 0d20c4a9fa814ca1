"""Exact row numbers per key, without a group that holds all rows of a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def number_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[str], tallies: dict[str, Column] | None = None) -> DataFrame:
    """Add ``row_no`` (from 0, in ``order`` within each key) and ``rows_total``.

    Two levels: rows are dealt out by ranges of (keys, order), whose borders follow the data
    however dense the order values lie, and written once.  Each range counts its rows per key;
    the prefix sums of these counts, a row per key and range, are the offsets of the ranges, and
    rows are numbered within their range only.  ``tallies`` are conditions whose rows are
    counted per key on the way.
    """
    placed = cut_lineage(rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    tallies = tallies or {}
    counts = placed.groupBy(*keys, "_range").agg(
        F.count("*").alias("_n"), *[F.count_if(condition).alias(name) for name, condition in tallies.items()])
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("rows_total"),
        *[F.sum(name).over(whole).alias(name) for name in tallies])
    within = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)) - 1
    numbered = placed.withColumn("_within", within).join(offsets, [*keys, "_range"])
    return numbered.withColumn("row_no", F.col("_within") + F.col("_before")).drop("_range", "_within", "_before")


def in_parts(rows: DataFrame, keys: Sequence[str], order: Sequence[str], size: int, row: Column, tallies: dict[str, Column] | None = None) -> DataFrame:
    """(keys, part_no, rows, rows_total, tallies): runs of ``size`` rows each, gathered in order."""
    numbered = number_rows(rows, keys, order, tallies)
    part = F.floor(F.col("row_no") / size).cast("long")
    totals = ("rows_total", *(tallies or {}))
    gathered = numbered.select(*keys, part.alias("part_no"), F.struct("row_no", row.alias("row")).alias("_row"), *totals).groupBy(*keys, "part_no").agg(
        F.array_sort(F.collect_list("_row")).alias("_rows"), *[F.max(t).alias(t) for t in totals])
    return gathered.withColumn("rows", F.transform("_rows", lambda r: r["row"])).drop("_rows")
