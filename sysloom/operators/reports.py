"""Report tables: documents, index, lookup, run forensics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as fx
from ..functions import packs
from ..schemas import COUNT_FIELDS, FINDING_FIELDS, REPORT_SCHEMA
from . import rules
from .numbering import in_parts

#: Findings of one document; a report with more has several.
DOCUMENT_FINDINGS = 10_000
ORDER = ("severity_rank", "phase", "order_key", "ordinal")


def order_findings(found: DataFrame) -> DataFrame:
    """Findings in report order.  The sort key starts with the run and goes down
    to the rule, so the range sort also splits a run with very many findings."""
    return found.orderBy("detonation_id", *ORDER, "kind", "key")


def report_documents(verdicts: DataFrame, found: DataFrame, analyzed_at: Column | None = None,
                     limit: int = DOCUMENT_FINDINGS) -> DataFrame:
    """Nested report documents, each with the next ``limit`` findings of its run in
    report order (part_no ascending); a run without findings has one empty document."""
    order = [*ORDER, "kind", "key"]
    parts = in_parts(found.select("detonation_id", *order, *FINDING_FIELDS), ["detonation_id"], order, limit, F.struct(*FINDING_FIELDS))
    nested = parts.select("detonation_id", "part_no", F.col("rows").alias("findings"))
    empty = F.array().cast(REPORT_SCHEMA["findings"].dataType)
    docs = verdicts.join(nested, "detonation_id", "left")
    return as_reports(docs.withColumn("findings", F.coalesce("findings", empty)).withColumn(
        "part_no", F.coalesce("part_no", F.lit(0).cast("long"))), analyzed_at)


def as_reports(docs: DataFrame, analyzed_at: Column | None = None) -> DataFrame:
    """Verdict rows that already carry ``findings`` in the report's schema."""
    when = F.current_timestamp() if analyzed_at is None else analyzed_at
    given = {"report_id": fx.report_id("detonation_id"), "analyzed_at": F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")}
    missing = {"part_no": F.lit(0), "executive_summary": F.lit(""), "attack_chain": F.array()}
    def column(field):
        if field.name in given:
            return given[field.name]
        return F.col(field.name) if field.name in docs.columns else missing[field.name]
    return docs.select(*[column(f).cast(f.dataType).alias(f.name) for f in REPORT_SCHEMA])


def report_index(reports: DataFrame) -> DataFrame:
    """One summary row per report, newest first; parts of a report are added up."""
    head = F.struct("package_name", "threat_score", "risk_level", "analyzed_at", "events_analyzed")
    parts = reports.groupBy("report_id").agg(
        F.min_by(head, "part_no").alias("head"), F.sum(F.coalesce(F.size("findings"), F.lit(0))).alias("findings"))
    text = lambda c: F.coalesce(F.col(f"head.{c}"), F.lit("")).alias(c)
    number = lambda c: F.coalesce(F.col(f"head.{c}"), F.lit(0)).alias(c)
    return parts.select("report_id", text("package_name"), number("threat_score"), text("risk_level"),
                        F.try_to_timestamp(F.col("head.analyzed_at")).alias("analyzed_at"),
                        number("events_analyzed"), "findings").orderBy(F.desc_nulls_last("analyzed_at"), "report_id")


def verdict_index(verdicts: DataFrame, analyzed_at: Column) -> DataFrame:
    """The same index straight from the verdicts, which count their findings: no document is built."""
    return verdicts.select(
        fx.report_id("detonation_id").alias("report_id"), "package_name", "threat_score", "risk_level", analyzed_at.alias("analyzed_at"),
        "events_analyzed", F.col("finding_count").alias("findings")).orderBy(F.desc_nulls_last("analyzed_at"), "report_id")


def requested_id(request: Column | str) -> Column:
    """Report id of a requested path: base name, with or without .json."""
    name = fx.basename(request)
    return F.regexp_replace(name, r"\.json$", "")


def report_by_id(reports: DataFrame, requests: DataFrame, column: str = "request") -> DataFrame:
    """Reports for a table of requested ids; unknown ids give nothing."""
    wanted = requests.select(requested_id(column).alias("report_id")).distinct()
    return reports.join(wanted, "report_id", "left_semi")


def requested_runs(runs: DataFrame, requests: DataFrame, column: str = "request") -> DataFrame:
    """The rows of ``runs`` whose report is asked for, to narrow the input before documents are built."""
    wanted = requests.select(requested_id(column).alias("_wanted")).distinct()
    return runs.join(wanted, fx.report_id("detonation_id") == F.col("_wanted"), "left_semi")


def run_forensics(events: DataFrame, runs: DataFrame) -> DataFrame:
    """Run report as numbers: duration, log size, counts, lists' sizes.  One pass
    over the events; the join with the runs is one row per run."""
    is_open = F.col("event_type") == "OPENAT"
    counted = events.groupBy("detonation_id").agg(
        F.count("*").alias("events_analyzed"),
        *rules.type_counts(),
        F.count_if(is_open & fx.contains_any("filename", packs.SENSITIVE_PATHS)).alias("suspicious_files"),
        F.count_if((F.col("event_type") == "UNLINK") & (F.col("filename") != "")).alias("deletions_listed"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    duration = F.round((F.unix_micros("ended_at") - F.unix_micros("started_at")) / 1000).cast("long")
    joined = runs.join(counted, "detonation_id", "left")
    return joined.select(
        "detonation_id", "package_name", F.substring("container_id", 1, 12).alias("container_id"), duration.alias("duration_ms"),
        fx.count_lines("log").alias("log_lines"), *[zero(c) for c in COUNT_FIELDS], zero("suspicious_files"),
        zero("deletions_listed"), F.greatest(F.coalesce("execve_count", F.lit(0)) - 15, F.lit(0)).alias("more_processes"), "success")


def log_tail(runs: DataFrame, n: int = 30) -> DataFrame:
    """The last n lines of each log without frame headers, and how many were cut."""
    lines = fx.log_lines("log")
    rows = runs.select("detonation_id", lines.alias("lines"))
    total = F.size("lines")
    first = F.greatest(total - n, F.lit(0))
    tail = rows.select("detonation_id", first.alias("truncated"),
                       F.posexplode(F.slice("lines", first + 1, n)).alias("pos", "line"))
    return tail.select("detonation_id", "truncated", (F.col("truncated") + F.col("pos") + 1).alias("line_no"),
                       fx.strip_frame_header("line").alias("line"))


def log_lines(runs: DataFrame) -> DataFrame:
    rows = runs.select("detonation_id", F.posexplode(fx.log_lines("log")).alias("pos", "line"))
    return rows.select("detonation_id", (F.col("pos") + 1).alias("line_no"), fx.strip_frame_header("line").alias("line"))

