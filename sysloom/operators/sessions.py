"""Sessions of a run: bursts of events separated by silence.

Batch form.  Events are first folded to one row per (run, time slot) with slots as wide as
the gap: two events of one slot always belong together, and only neighbouring slots can, so
this loses nothing and runs map-side.  Sessions are then found by a segmented scan: each
(run, time block) finds the starts inside it on its own, and one row per block carries the
open session over the block edges.  A block spans ``BLOCK_SLOTS`` gaps, so the carry of a run
has a row per block of its life, however many events it holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAP_SECONDS = 8.0
BLOCK_SLOTS = 1 << 16


def time_slot(time: Column | str, gap_micros: int) -> Column:
    """Start of the gap-wide slot that holds a time, in microseconds."""
    micros = F.unix_micros(time)
    return micros - F.pmod(micros, F.lit(gap_micros))


def intervals(events: DataFrame, gap_seconds: float = GAP_SECONDS, time: str = "captured_at",
              keys: Sequence[str] = ("detonation_id",), block_slots: int = BLOCK_SLOTS) -> DataFrame:
    """(keys, first, last, events, last_seq, package_name): sessions in microseconds.

    A silence longer than the gap starts a new session; the event with the greatest ``seq``
    names the package.
    """
    gap = int(gap_seconds * 1_000_000)
    micros = F.unix_micros(time)
    # the package is a key first, as its text would keep the sums out of the hash aggregate
    slots = events.groupBy(*keys, time_slot(time, gap).alias("slot"), "package_name").agg(
        F.min(micros).alias("first"), F.max(micros).alias("last"), F.max("seq").alias("last_seq"), F.count("*").alias("n"))
    slots = slots.groupBy(*keys, "slot").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"),
        F.max(F.struct("last_seq", "package_name")).alias("top"))
    slots = slots.withColumn("block", F.col("slot") - F.pmod("slot", F.lit(gap * block_slots)))

    inside = Window.partitionBy(*keys, "block").orderBy("slot")
    opens = F.col("first") - F.lag("last").over(inside) > gap
    begun = F.max(F.when(F.col("opens"), F.col("slot"))).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    slots = slots.withColumn("opens", opens).withColumn("begun", begun)
    blocks = slots.groupBy(*keys, "block").agg(
        F.min("slot").alias("head"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("begun").alias("tail"))
    along = Window.partitionBy(*keys).orderBy("block")
    silent = F.coalesce(F.col("first") - F.lag("last").over(along) > gap, F.lit(True))
    blocks = blocks.withColumn("entry", F.when(silent, F.col("head")))
    carried = F.last(F.coalesce("tail", "entry"), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    edges = blocks.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("block").alias("_block"), F.coalesce("entry", carried).alias("entry"))
    same = F.col("block").eqNullSafe(F.col("_block"))
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    named = slots.join(edges, same).withColumn("session", F.coalesce("begun", "entry"))
    return named.groupBy(*keys, "session").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("events"), F.max("top").alias("top")).select(
        *keys, "first", "last", "events", F.col("top.last_seq").alias("last_seq"), F.col("top.package_name").alias("package_name"))


def sessionize(events: DataFrame, gap_seconds: float = GAP_SECONDS, time: str = "captured_at",
               keys: Sequence[str] = ("detonation_id",), block_slots: int = BLOCK_SLOTS) -> DataFrame:
    """(keys, session_start, session_last, events, package_name)."""
    found = intervals(events, gap_seconds, time, keys, block_slots)
    return found.select(*keys, F.timestamp_micros("first").alias("session_start"), F.timestamp_micros("last").alias("session_last"), "events", "package_name")


def join_intervals(rows: DataFrame, gap_seconds: float = GAP_SECONDS, key: str = "detonation_id") -> DataFrame:
    """``rows`` (key, first, last) with ``island``: what lies within the gap of each other shares one."""
    gap = int(gap_seconds * 1_000_000)
    order = Window.partitionBy(key).orderBy("first", "last")
    before = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce((F.col("first") - before > gap).cast("int"), F.lit(1))
    return rows.withColumn("opens", opens).withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("opens")


def attach_sessions(events: DataFrame, sessions: DataFrame, gap_seconds: float = GAP_SECONDS, time: str = "captured_at",
                    keys: Sequence[str] = ("detonation_id",)) -> DataFrame:
    """Events with the start of the session they fall in.

    A session is unfolded into its time slots (at most about two per event) and
    joined by (keys, slot).  Sessions lie more than a gap apart, so a slot has
    one session at most: the join is an equi-join with one match per event, and
    the slot spreads the events of a very large run over the partitions.
    """
    gap = int(gap_seconds * 1_000_000)
    first, last = time_slot("session_start", gap), time_slot("session_last", gap)
    slots = sessions.select(*keys, "session_start", F.col("session_last").alias("_last"),
                            F.explode(F.sequence(first, last, F.lit(gap).cast("long"))).alias("_slot"))
    joined = events.withColumn("_slot", time_slot(time, gap)).join(slots, [*keys, "_slot"])
    return joined.filter(F.col(time).between(F.col("session_start"), F.col("_last"))).drop("_last", "_slot")
