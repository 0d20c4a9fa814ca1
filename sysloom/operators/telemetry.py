"""Event-level operators: filters, previews, capture windows, delivery audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as fx
from ..functions import packs

# fixed values: what the capture keeps
AF_INET = 2
SOCKADDR_IN_BYTES = 16
LAST_STANDARD_FD = 2
CALL_TO_EVENT = {"execve": "EXECVE", "openat": "OPENAT", "open": "OPENAT", "connect": "CONNECT",
                 "write": "WRITE", "unlinkat": "UNLINK"}


def filter_events(events: DataFrame, event_type: str) -> DataFrame:
    return events.filter(F.col("event_type") == event_type)


def unsafe_file_access(events: DataFrame, prefixes=packs.SAFE_PREFIXES) -> DataFrame:
    """Opened files outside the places a normal install touches."""
    opens = filter_events(events, "OPENAT").withColumn("path", fx.strip_ws("filename"))
    return opens.filter(~fx.is_safe_path("path", prefixes)).drop("path")


def suspicious_file_access(events: DataFrame, paths=packs.SENSITIVE_PATHS) -> DataFrame:
    """Opened files on the sensitive list, each event once."""
    return filter_events(events, "OPENAT").filter(fx.contains_any("filename", paths))


def external_connections(events: DataFrame) -> DataFrame:
    found = filter_events(events, "CONNECT").filter(fx.is_external("connect_ip"))
    return found.withColumn("ip", fx.ipv4("connect_ip")).withColumn("known_cdn", fx.is_known_cdn("connect_ip"))


def noise_filter(trace: DataFrame) -> DataFrame:
    """Reduce a host trace to the five event types, as the capture does at the source."""
    call = F.col("syscall")
    event = F.coalesce(*[F.when(call == c, t) for c, t in CALL_TO_EVENT.items()])
    useful_write = (F.col("write_fd") > LAST_STANDARD_FD) & (F.col("write_bytes") > 0)
    ipv4 = (F.col("family") == AF_INET) & (F.col("addrlen") >= SOCKADDR_IN_BYTES)
    kept = trace.filter(call.isin(*CALL_TO_EVENT) & ((call != "write") | useful_write) & ((call != "connect") | ipv4))
    return kept.withColumn("event_type", event).withColumn(
        "connect_port", F.when(call == "connect", fx.swap_port("port_be")).otherwise(0).cast("long"))


def preview_telemetry(events: DataFrame, n: int = 10) -> DataFrame:
    """The first n records as one display line each."""
    known = lambda c: F.coalesce(F.col(c), F.lit("?"))
    padded = lambda c, width: F.when(F.length(c) < width, F.rpad(c, width, " ")).otherwise(c)
    line = F.concat(padded(known("event_type"), 6), F.lit(" | "), padded(known("process_name"), 15),
                    F.lit(" → "), F.substring(known("filename"), 1, 50))
    return events.orderBy("seq").limit(n).select("seq", line.alias("line"))


def top_processes(events: DataFrame, n: int = 15) -> DataFrame:
    """The first n EXECVEs of a run and how many more there are.

    ``row_number() <= n`` lets Spark keep n rows per run on the map side
    (WindowGroupLimit) before the shuffle, so a huge run costs n rows a task.
    """
    execs = filter_events(events, "EXECVE").select("detonation_id", "seq", "pid", "process_name", "filename")
    order = Window.partitionBy("detonation_id").orderBy("seq")
    first = execs.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= n)
    total = execs.groupBy("detonation_id").agg(F.count("*").alias("total"))
    return first.join(total, "detonation_id").withColumn("more", F.greatest(F.col("total") - n, F.lit(0))).drop("total")


def detonation_window(events: DataFrame, runs: DataFrame, seconds: float = 30.0) -> DataFrame:
    """Events inside the capture window, which ends early when the run does."""
    end = F.least(F.timestamp_micros(F.unix_micros("started_at") + int(seconds * 1_000_000)), F.col("ended_at"))
    bounds = runs.select("detonation_id", F.col("started_at").alias("_from"), end.alias("_to"))
    return events.join(bounds, "detonation_id").filter(
        F.col("captured_at").between(F.col("_from"), F.col("_to"))).drop("_from", "_to")


def delivery_audit(captured: DataFrame, delivered: DataFrame) -> DataFrame:
    """Per run: events captured, delivered and lost.  Both sides are counted
    before the join, so the join sees one row per run."""
    have = captured.groupBy("detonation_id").agg(F.count("*").alias("captured"))
    got = delivered.groupBy("detonation_id").agg(F.count("*").alias("streamed"))
    streamed = F.coalesce("streamed", F.lit(0))
    return have.join(got, "detonation_id", "left").select(
        "detonation_id", "captured", streamed.alias("streamed"), (F.col("captured") - streamed).alias("failed"))


def undelivered(captured: DataFrame, delivered: DataFrame) -> DataFrame:
    """The captured events that never reached the topic."""
    return captured.join(delivered.select("detonation_id", "seq"), ["detonation_id", "seq"], "left_anti")
