"""Connected components of a table of links, labelled with the smallest member."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, release


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): for each node that has a link, the smallest node reachable.

    Alternates the large-star and the small-star step until nothing changes; the number of
    rounds is logarithmic in the longest chain.  Each round is two grouped minima with
    map-side partials and two equi-joins, written to the shared folder; nothing of the graph
    reaches the driver.  Links from a node to itself and null ends are left out.
    """
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    state, seen = cut_lineage(pairs), None
    while True:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = cut_lineage(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = cut_lineage(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        mark = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        release(state, large)
        state = new
        if mark == seen:
            break
        seen = mark
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
