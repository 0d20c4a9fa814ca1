"""Streaming verdicts with the same scoring plan as batch.

One query takes telemetry and, if there are any, a model's answers.  Each micro-batch
appends its events, folds them to time intervals per run and merges these with the stored
sessions they touch, be they open or long closed: a late event extends, joins or adds sessions just
as if it had come in time.  Sessions that the watermark has passed, that changed after it had,
or that got an answer are scored from the event table with the batch functions, and their
reports are replaced.  So whatever the order of arrival, the tables end up as a batch over all
events would leave them.

State lives in versioned tables (``LogTable``), one version per micro-batch: a replayed batch
overwrites its own version, and versions are merged as they add up.  Reads are bounded by time:
old folders are skipped by their statistics unless a late event reaches back to them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType, StructField, StructType, TimestampType

from ..operators import narrative, registry, reports, rules, sessions
from ..schemas import REPORT_SCHEMA
from ..session import cut_lineage, release
from ..sources import syscalls
from .log_table import FAN, LogTable

EVENT_TABLE_SCHEMA = (
    "seq long, package_name string, container_id string, detonation_id string, pid long, ppid long, timestamp_ns long, "
    "event_type string, process_name string, filename string, captured_at timestamp, connect_port long, connect_ip long, "
    "write_bytes long, write_fd long")
ANSWER_SCHEMA = "detonation_id string, session_start timestamp, chain boolean, seq long, response string"
SESSION_SCHEMA = (
    "detonation_id string, session_start timestamp, session_last timestamp, first long, last long, events long, last_seq long, "
    "package_name string, status string")
OPEN, CLOSED, ABSORBED = "open", "closed", "absorbed"
SESSION = ("detonation_id", "session_start")
DELAY_SECONDS = 30.0


@dataclass
class VerdictTables:
    """The tables of one stream, in one shared folder."""
    events: LogTable
    rejects: LogTable
    answers: LogTable
    sessions: LogTable
    reports: LogTable
    clock: LogTable

    @classmethod
    def under(cls, spark: SparkSession, folder: str, fan: int = FAN) -> VerdictTables:
        report = StructType([*REPORT_SCHEMA, StructField("session_start", TimestampType()), StructField("gone", BooleanType())])
        table = lambda name, schema, keys=(): LogTable(spark, f"{folder}/{name}", schema, keys, fan)
        return cls(table("events", EVENT_TABLE_SCHEMA), table("rejects", "value string, reason string"), table("answers", ANSWER_SCHEMA),
                   table("sessions", SESSION_SCHEMA, SESSION), table("reports", report, SESSION), table("clock", "watermark long"))

    def all(self) -> list[LogTable]:
        return [self.events, self.rejects, self.answers, self.sessions, self.reports, self.clock]


def score_batch(events: DataFrame, registry_table: DataFrame | None = None, as_of: Column | None = None,
                responses: DataFrame | None = None, chains: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The whole verdict pipeline over one set of complete runs: (verdicts, findings).

    Metadata, rules, triage, merge of answers, attack chain -- in that order.
    """
    scored, found = rules.verdicts(events), rules.findings(events)
    if registry_table is not None:
        signals = registry.metadata_findings(registry_table, F.current_timestamp() if as_of is None else as_of)
        extra = registry.run_metadata_findings(scored, signals)
        scored = registry.merge_metadata(scored, signals)
        # registry findings come after the sorted rule findings
        found = found.unionByName(extra.select(
            "detonation_id", F.lit("registry").alias("kind"), F.col("ordinal").cast("string").alias("key"),
            F.lit(0).alias("phase"), F.lit(0).cast("long").alias("order_key"), "ordinal", F.lit(0).cast("long").alias("points"),
            "severity", "category", "description", "evidence", "mitre_id", "mitre_name", F.lit(9).alias("severity_rank")))
    if responses is not None:
        scored = narrative.merge_responses(scored, responses)
    if chains is not None:
        scored = narrative.merge_attack_chains(scored, chains)
    return scored, found


def report_batch(scored: DataFrame, found: DataFrame, analyzed_at: Column | None = None) -> DataFrame:
    """Report documents; an answer's findings replace the listed ones."""
    if "model_findings" not in scored.columns:
        return reports.report_documents(scored, found, analyzed_at)
    replaced = F.col("model_findings").isNotNull()
    answered = reports.as_reports(scored.filter(replaced).withColumn("findings", F.col("model_findings")), analyzed_at)
    return reports.report_documents(scored.filter(~replaced), found, analyzed_at).unionByName(answered)


Score = Callable[..., tuple[DataFrame, DataFrame]]


def _session_run(start: str = "session_start") -> Column:
    """While it is scored, a session is a run of its own."""
    return F.concat_ws("@", "detonation_id", F.unix_micros(start).cast("string"))


def session_events(events: DataFrame, found: DataFrame, gap_seconds: float = sessions.GAP_SECONDS) -> DataFrame:
    """The events of the sessions ``found``, each session as a run of its own."""
    return sessions.attach_sessions(events, found.select(*SESSION, "session_last"), gap_seconds).withColumn("detonation_id", _session_run())


def session_reports(keyed: DataFrame, answers: DataFrame | None = None, score: Score = score_batch, analyzed_at: Column | None = None) -> DataFrame:
    """Report documents with their ``session_start`` for the sessions of ``session_events``.

    ``answers`` has (detonation_id, session_start, chain, seq, response); the last one of a
    session counts.  An answer to a session with another start is not used: it was asked about other events.
    """
    given = {}
    if answers is not None:
        last = answers.groupBy(_session_run().alias("detonation_id"), "chain").agg(F.max_by("response", F.struct("seq", "response")).alias("response"))
        given = {"responses": last.filter("not chain").drop("chain"), "chains": last.filter("chain").drop("chain")}
    documents = report_batch(*score(keyed, **given), analyzed_at)
    start = F.timestamp_micros(F.regexp_extract("detonation_id", r"@(\d+)$", 1).cast("long"))
    plain = lambda c: F.regexp_replace(c, r"@\d+$", "").alias(c)
    return documents.select(
        *[plain(c) if c in ("detonation_id", "report_id") else F.col(c) for c in documents.columns], start.alias("session_start"))


def last_per_run(documents: DataFrame) -> DataFrame:
    """The report of a run is the one of its last session, with all its parts."""
    last = documents.groupBy("report_id").agg(F.max("session_start").alias("session_start"))
    return documents.join(last, ["report_id", "session_start"], "left_semi")


def batch_reports(events: DataFrame, answers: DataFrame | None = None, gap_seconds: float = sessions.GAP_SECONDS,
                  score: Score = score_batch, analyzed_at: Column | None = None) -> DataFrame:
    """The reports that a stream over the same events and answers ends with."""
    found = sessions.sessionize(events, gap_seconds)
    return last_per_run(session_reports(session_events(events, found, gap_seconds), answers, score, analyzed_at))


# ---------------------------------------------------------------- one step
def _merged(tables: VerdictTables, version: int, gap_seconds: float) -> DataFrame | None:
    """The new intervals and the stored sessions near them, numbered by the session they now form.

    ``_first``, ``_last`` and ``touched`` tell of that session where it begins and ends and whether it has new events.
    """
    gap = int(gap_seconds * 1_000_000)
    # read three times below, so written once
    new = cut_lineage(sessions.intervals(tables.events.at(version), gap_seconds).withColumn("is_new", F.lit(True)))
    span = new.agg(F.min("first").alias("a"), F.max("last").alias("b")).first()
    if span.a is None:
        release(new)
        return None
    # a session's last time only grows, so the bound holds for all later versions of a key
    stored = tables.sessions.latest(version, F.col("last") >= span.a - gap).filter((F.col("status") != ABSORBED) & (F.col("first") <= span.b + gap))
    stored = stored.join(new.select("detonation_id").distinct(), "detonation_id", "left_semi")
    columns = ["detonation_id", "first", "last", "events", "last_seq", "package_name", "is_new"]
    both = new.select(*columns).unionByName(stored.withColumn("is_new", F.lit(False)).select(*columns))
    island = Window.partitionBy("detonation_id", "island")
    merged = cut_lineage(sessions.join_intervals(both, gap_seconds).select(
        "*", F.min("first").over(island).alias("_first"), F.max("last").over(island).alias("_last"), F.max("is_new").over(island).alias("touched")))
    release(new)
    return merged


def _session_rows(tables: VerdictTables, version: int, merged: DataFrame | None, watermark: Column, since: int | None, gap: int) -> DataFrame:
    """What changes in the session table: sessions that grew, that others took in, and that the watermark has passed."""
    is_over = F.when(F.col("last") + gap < watermark, CLOSED).otherwise(OPEN)
    spark = tables.sessions.spark
    rows = spark.createDataFrame([], "detonation_id string, first long, last long, events long, last_seq long, package_name string, status string")
    if merged is not None:
        islands = merged.filter("touched").groupBy("detonation_id", "island").agg(
            F.min("first").alias("first"), F.max("last").alias("last"), F.sum("events").alias("events"),
            F.max(F.struct("last_seq", "package_name")).alias("top"))
        grown = islands.select("detonation_id", "first", "last", "events", "top.last_seq", "top.package_name", is_over.alias("status"))
        taken = merged.filter("touched and not is_new")
        absorbed = taken.filter("first <> _first").select(
            "detonation_id", "first", F.col("_last").alias("last"), "events", "last_seq", "package_name", F.lit(ABSORBED).alias("status"))
        rows = rows.unionByName(grown).unionByName(absorbed)
    if since is not None:
        waiting = tables.sessions.latest(version, F.col("last") >= since - gap).filter((F.col("status") == OPEN) & (F.col("last") + gap < watermark))
        if merged is not None:
            waiting = waiting.join(taken.select("detonation_id", "first"), ["detonation_id", "first"], "left_anti")
        rows = rows.unionByName(waiting.select(*rows.columns[:-1], F.lit(CLOSED).alias("status")))
    return rows.withColumns({"session_start": F.timestamp_micros("first"), "session_last": F.timestamp_micros("last")})


def _due(tables: VerdictTables, version: int) -> DataFrame:
    """Closed sessions that changed or got an answer in this version."""
    changed = tables.sessions.at(version).filter(F.col("status") == CLOSED)
    asked = tables.answers.at(version).select(*SESSION).distinct()
    ends = asked.agg(F.min("session_start").alias("a"), F.max("session_start").alias("b")).first()
    if ends.a is None:
        return changed
    known = tables.sessions.latest(version + 1, F.col("session_start").between(ends.a, ends.b)).filter(F.col("status") == CLOSED)
    return changed.unionByName(known.join(asked, list(SESSION), "left_semi")).dropDuplicates(list(SESSION))


def advance(tables: VerdictTables, version: int, events: DataFrame | None = None, answers: DataFrame | None = None,
            gap_seconds: float = sessions.GAP_SECONDS, delay_seconds: float = DELAY_SECONDS, score: Score = score_batch,
            analyzed_at: Column | None = None, close_all: bool = False) -> None:
    """Take one batch of decoded events and answers; versions count up from 0.

    A version that broke off is simply taken again: it reads what lies before it and
    overwrites what it left.  ``close_all`` closes every session, for the end of the input.
    """
    gap, delay = (int(s * 1_000_000) for s in (gap_seconds, delay_seconds))
    for table in tables.all():
        table.compact(version)
    if events is not None:
        tables.events.append(events.filter("captured_at is not null and detonation_id is not null"), version)
    if answers is not None:
        tables.answers.append(answers.filter("session_start is not null and detonation_id is not null"), version)
    since = tables.clock.read(version).agg(F.max("watermark").alias("w")).first().w
    merged = _merged(tables, version, gap_seconds) if events is not None else None
    seen = None if merged is None else merged.filter("is_new").agg(F.max("last").alias("last")).first().last
    marks = [x for x in (since, None if seen is None else seen - delay) if x is not None]
    reached = max(marks, default=None)
    watermark = F.lit((1 << 62) if close_all else reached if reached is not None else -(1 << 62))
    tables.sessions.append(_session_rows(tables, version, merged, watermark, since, gap), version)
    if merged is not None:
        release(merged)

    due = cut_lineage(_due(tables, version))
    span = due.agg(F.min("session_start").alias("a"), F.max("session_last").alias("b")).first()
    gone = tables.sessions.at(version).filter(F.col("status") == ABSORBED).select(*SESSION, F.lit(True).alias("gone"))
    none = tables.reports.spark.createDataFrame([], tables.reports.schema).drop("version")
    rows = none.unionByName(gone, allowMissingColumns=True)
    keyed = None
    if span.a is not None:
        history = tables.events.read(version + 1).filter(F.col("captured_at").between(span.a, span.b))
        known = None
        if tables.answers.spans(before=version + 1):
            near = tables.answers.read(version + 1).filter(F.col("session_start").between(span.a, span.b))
            known = near.join(due.select(*SESSION), list(SESSION), "left_semi")
        # scoring reads its events several times, so they are joined to their sessions once
        keyed = cut_lineage(session_events(history, due, gap_seconds))
        scored = session_reports(keyed, known, score, analyzed_at)
        rows = rows.unionByName(scored.withColumn("gone", F.lit(False)), allowMissingColumns=True)
    tables.reports.append(rows, version)
    release(due, *([] if keyed is None else [keyed]))
    if reached is not None:
        tables.clock.append(tables.clock.spark.createDataFrame([(reached,)], "watermark long").coalesce(1), version)


def active_sessions(tables: VerdictTables) -> DataFrame:
    """Open sessions and their sizes as of the last version."""
    return tables.sessions.latest().filter(F.col("status") == OPEN).select(*SESSION, "session_last", "events", "package_name")


def session_changes(tables: VerdictTables) -> DataFrame:
    """Every change of a session with the version that made it: sizes while open, then a closing row.

    Versions that have been merged keep the newest change of each session.
    """
    return tables.sessions.read().select("version", *SESSION, "session_last", "events", "package_name", "status")


def closed_sessions(tables: VerdictTables) -> DataFrame:
    return tables.sessions.latest().filter(F.col("status") == CLOSED).select(*SESSION, "session_last", "events", "package_name")


def current_reports(tables: VerdictTables) -> DataFrame:
    """One report per run, of its last closed session."""
    return last_per_run(tables.reports.latest().filter("not gone")).drop("gone", "version")


# ---------------------------------------------------------------- the query
def decode_batch(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages (seq, value, arrived_at) to (events, rejects).

    An event without a readable capture time counts from its arrival, which does not
    change when the batch is read again.
    """
    events, rejects = syscalls.decode_syscalls(raw, ("seq", "arrived_at"))
    events = syscalls.with_arrival_order(events)
    return events.withColumn("captured_at", F.coalesce("captured_at", "arrived_at")).drop("arrived_at"), rejects.select("value", "reason")


def decode_answers(raw: DataFrame) -> DataFrame:
    """JSON answers (detonation_id, session_start in microseconds, chain, response) as columns."""
    fields = F.from_json("value", "detonation_id string, session_start long, chain boolean, response string")
    return raw.select("seq", fields.alias("a")).select(
        "a.detonation_id", F.timestamp_micros("a.session_start").alias("session_start"), F.coalesce("a.chain", F.lit(False)).alias("chain"), "seq", "a.response")


def run_verdicts(raw: DataFrame, folder: str, checkpoint: str, answers: DataFrame | None = None, trigger: dict | None = None,
                 fan: int = FAN, **options) -> StreamingQuery:
    """Keep the tables under ``folder`` up to date with the messages and answers (seq, value, arrived_at) that arrive."""
    stream = raw.select("seq", "value", "arrived_at", F.lit(False).alias("is_answer"))
    if answers is not None:
        stream = stream.unionByName(answers.select("seq", "value", "arrived_at", F.lit(True).alias("is_answer")))

    def handle(batch: DataFrame, batch_id: int) -> None:
        tables = VerdictTables.under(batch.sparkSession, folder, fan)
        batch = batch.persist()
        try:
            events, rejects = decode_batch(batch.filter("not is_answer"))
            tables.rejects.append(rejects, batch_id)
            advance(tables, batch_id, events, decode_answers(batch.filter("is_answer")) if answers is not None else None, **options)
        finally:
            batch.unpersist()

    return (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "2 seconds"})).start())
