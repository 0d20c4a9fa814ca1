"""Registered queries: every operator over whole adapter views.

Times are given as epoch microseconds and integers as longs, so that results
compare value by value with another engine.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, ShortType, TimestampType

from ..functions import columns as fx
from ..functions import packs
from ..operators import (
    dependencies, lineage, narrative, registry, reports, rules, sessions, static_scan, telemetry,
)
from ..session import configure, cut_lineage, scratch_folder
from ..sources import raw_records, syscalls
from ..streaming import verdicts as stream
from . import adapters as a

Query = Callable[[SparkSession, str], DataFrame]
SESSION_GAP_SECONDS = 6 * 3600
CAPTURE_SECONDS = 2 * 86_400
STREAM_DELAY_SECONDS = 86_400
LIMIT = 3
PART_LINES, PART_FINDINGS = 7, 2
_QUERIES: dict[str, Query] = {}


def _plain(df: DataFrame) -> DataFrame:
    """Longs for integers, epoch microseconds for timestamps."""
    def plain(field):
        c = F.col(field.name)
        if isinstance(field.dataType, (IntegerType, ShortType)):
            return c.cast("long").alias(field.name)
        if isinstance(field.dataType, TimestampType):
            return F.unix_micros(c).alias(field.name)
        return c
    return df.select(*[plain(f) for f in df.schema])


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return _plain(fn(spark, sf_dir))
    run.__name__ = fn.__name__
    _QUERIES[fn.__name__] = run
    return fn


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _as_of():
    return F.lit(a.AS_OF).cast("timestamp")


# ------------------------------------------------------------ projections
@query
def event_type_name(spark, d):
    code = F.coalesce(*[F.when(F.col("event_type") == n, c) for c, n in packs.EVENT_TYPES.items()], F.lit(99))
    v = a.syscalls(spark, d).select("seq", code.alias("code"))
    return v.select("seq", "code", fx.event_type_name("code").alias("event_type"))


@query
def ipv4_decode(spark, d):
    return telemetry.filter_events(a.syscalls(spark, d), "CONNECT").select("seq", "connect_ip", fx.ipv4("connect_ip").alias("ip"))


@query
def exec_basenames(spark, d):
    return telemetry.filter_events(a.syscalls(spark, d), "EXECVE").select("seq", fx.basename("filename").alias("basename"))


@query
def events_by_type(spark, d):
    return telemetry.filter_events(a.syscalls(spark, d), "WRITE").select("detonation_id", "seq", "process_name", "write_bytes", "write_fd")


@query
def unsafe_file_access(spark, d):
    return telemetry.unsafe_file_access(a.syscalls(spark, d)).select("detonation_id", "seq", "filename")


@query
def suspicious_file_access(spark, d):
    return telemetry.suspicious_file_access(a.syscalls(spark, d)).select("detonation_id", "seq", "process_name", "filename")


@query
def external_connections(spark, d):
    return telemetry.external_connections(a.syscalls(spark, d)).select("detonation_id", "seq", "ip", "connect_port", "known_cdn")


@query
def nonstandard_processes(spark, d):
    execs = telemetry.filter_events(a.syscalls(spark, d), "EXECVE").withColumn("process", fx.strip_ws("process_name"))
    return execs.filter(fx.is_nonstandard_process("process")).select("detonation_id", "seq", "process")


@query
def noise_filter(spark, d):
    return telemetry.noise_filter(a.host_trace(spark, d)).select("seq", "event_type", "write_fd", "write_bytes", "connect_port")


@query
def raw_records_decoded(spark, d):
    packed = raw_records.encode_raw_records(a.syscalls(spark, d))
    return raw_records.decode_raw_records(packed).select("seq", *raw_records.FIELDS)


@query
def container_ids(spark, d):
    return a.cgroup_lines(spark, d).select("line_no", "pid", fx.in_container("line").alias("in_container"), fx.container_id("line").alias("container_id"))


@query
def sanitized_names(spark, d):
    r = a.registry(spark, d).withColumn("raw", F.concat(F.when(F.col("part_key") % 5 == 0, "@scope/").when(
        F.col("part_key") % 5 == 1, "._-").otherwise(""), F.when(F.col("part_key") % 23 == 0, "").otherwise(F.col("package_name"))))
    return r.select("registry_key", "raw", fx.sanitize_name("raw").alias("clean"))


@query
def detonation_ids(spark, d):
    runs = a.run_bounds(spark, d)
    return runs.select("detonation_id", fx.detonation_id("package_name", "started_at").alias("generated_id"))


@query
def clean_log_lines(spark, d):
    return reports.log_lines(a.run_bounds(spark, d))


@query
def log_line_counts(spark, d):
    return a.run_bounds(spark, d).select("detonation_id", fx.count_lines("log").alias("lines"))


@query
def log_tail(spark, d):
    return reports.log_tail(a.run_bounds(spark, d), 30)


@query
def preview_telemetry(spark, d):
    return telemetry.preview_telemetry(a.syscalls(spark, d), 10)


@query
def scannable_files(spark, d):
    return static_scan.filter_scannable(a.package_files(spark, d)).select("package", "path", F.length("content").alias("chars"))


@query
def decode_syscalls(spark, d):
    accepted, _ = syscalls.decode_syscalls(a.raw_messages(spark, d), keep=("seq",))
    return accepted


@query
def rejected_syscalls(spark, d):
    _, rejected = syscalls.decode_syscalls(a.raw_messages(spark, d), keep=("seq",))
    return rejected.select("seq", "value", "reason")


@query
def syscalls_wire(spark, d):
    v = a.syscalls(spark, d).withColumn("captured_at", F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    return syscalls.to_wire(v).select("key", "value")


# ------------------------------------------------------------ runtime rules
@query
def exec_rule_hits(spark, d):
    return rules.match_exec_rules(a.syscalls(spark, d))


@query
def file_rule_hits(spark, d):
    return rules.match_file_rules(a.syscalls(spark, d))


@query
def unlink_findings(spark, d):
    return rules.unlink_findings(a.syscalls(spark, d))


@query
def exec_burst(spark, d):
    return rules.exec_burst(a.syscalls(spark, d, by_user=True))


@query
def connection_findings(spark, d):
    return rules.connection_findings(a.syscalls(spark, d))


@query
def event_type_counts(spark, d):
    return rules.event_type_counts(a.syscalls(spark, d))


@query
def findings(spark, d):
    return rules.findings(a.syscalls(spark, d)).drop("severity_rank", "phase", "order_key", "ordinal")


@query
def threat_scores(spark, d):
    return rules.verdicts(a.syscalls(spark, d)).select("detonation_id", "threat_score")


@query
def verdicts(spark, d):
    return rules.verdicts(a.syscalls(spark, d))


@query
def user_verdicts(spark, d):
    """Long runs, where the burst rule fires."""
    return rules.verdicts(a.syscalls(spark, d, by_user=True))


@query
def risk_bands(spark, d):
    return rules.verdicts(a.syscalls(spark, d)).select("detonation_id", "threat_score", "risk_level", "recommendation")


@query
def mitre_summary(spark, d):
    v = a.syscalls(spark, d)
    return rules.mitre_summary(rules.findings(v), rules.run_packages(v))


@query
def category_summary(spark, d):
    v = a.syscalls(spark, d)
    return rules.category_summary(rules.findings(v), rules.run_packages(v))


@query
def ordered_findings(spark, d):
    return reports.order_findings(rules.findings(a.syscalls(spark, d, by_user=True))).select(
        "detonation_id", "severity_rank", "phase", "order_key", "ordinal", "kind", "key", "description", "evidence")


# ------------------------------------------------------------ registry
@query
def package_age(spark, d):
    return registry.package_age(a.registry(spark, d), _as_of())


@query
def low_downloads(spark, d):
    return registry.low_downloads(a.registry(spark, d))


@query
def single_maintainer(spark, d):
    return registry.single_maintainer(a.registry(spark, d))


@query
def typosquat_candidates(spark, d):
    return registry.typosquat_candidates(a.registry(spark, d))


@query
def typosquat_from_table(spark, d):
    return registry.typosquat_candidates(a.registry(spark, d), a.known_names(spark, d))


@query
def registry_summary_from_table(spark, d):
    return registry.registry_summary(a.registry(spark, d), _as_of(), a.known_names(spark, d)).select("registry_key", "available", "typosquat_target")


@query
def metadata_findings_from_table(spark, d):
    return registry.metadata_findings(a.registry(spark, d), _as_of(), a.known_names(spark, d)).select("registry_key", "ordinal", "severity", "evidence")


@query
def not_in_registry(spark, d):
    return registry.not_in_registry(a.registry(spark, d))


@query
def registry_summary(spark, d):
    return registry.registry_summary(a.registry(spark, d), _as_of())


@query
def metadata_findings(spark, d):
    return registry.metadata_findings(a.registry(spark, d), _as_of()).select("registry_key", "ordinal", "severity", "description", "evidence")


def _merged(spark, d):
    signals = registry.metadata_findings(a.registry(spark, d), _as_of())
    return registry.merge_metadata(rules.verdicts(a.syscalls(spark, d)), signals)


@query
def merged_verdicts(spark, d):
    return _merged(spark, d).select("detonation_id", "package_name", "threat_score", "risk_level", "metadata_findings", "finding_count")


@query
def run_metadata_findings(spark, d):
    signals = registry.metadata_findings(a.registry(spark, d), _as_of())
    return registry.run_metadata_findings(rules.verdicts(a.syscalls(spark, d)), signals).select("detonation_id", "ordinal", "severity", "evidence")


# ------------------------------------------------------------ static scan
def _package(spark, d):
    return a.package_files(spark, d).unionByName(a.manifests(spark, d))


@query
def lifecycle_hooks(spark, d):
    return static_scan.lifecycle_hooks(a.manifests(spark, d)).select("package", "hook", "severity", "evidence", "mitre_id")


@query
def scan_patterns(spark, d):
    return static_scan.scan_patterns(a.package_files(spark, d))


@query
def scan_findings(spark, d):
    return static_scan.scan_findings(_package(spark, d)).select("package", "path", "rule_no", "severity_rank", "severity", "evidence")


@query
def static_score(spark, d):
    return static_scan.static_score(static_scan.scan_findings(_package(spark, d)))


@query
def scan_custom_pack(spark, d):
    docs = a.table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("text_id"), F.col("text").alias("content"))
    pages = a.table(spark, d, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("text_id"), F.col("html").alias("content"))
    return static_scan.scan_rule_pack(docs.unionByName(pages), a.CUSTOM_RULES, ids=("text_id",)).select("text_id", "rule_no", "line_no")


# ------------------------------------------------------------ dependencies
@query
def npm_lock_targets(spark, d):
    return dependencies.npm_lock_targets(a.npm_lockfiles(spark, d))


@query
def npm_v1_targets(spark, d):
    return dependencies.npm_v1_targets(a.npm_v1_lockfiles(spark, d)).select("project", "name", "version")


@query
def pnpm_targets(spark, d):
    return dependencies.pnpm_targets(a.pnpm_lockfiles(spark, d))


@query
def rejected_lockfiles(spark, d):
    """Lockfiles cut short, or written in flow style, among good ones."""
    kinds = {"npm": a.npm_lockfiles, "manifest": a.bare_manifests, "pnpm": a.pnpm_lockfiles}
    found = [dependencies.rejected_lockfiles(a.damaged_lockfiles(files(spark, d)), kind).withColumn("dialect", F.lit(kind)) for kind, files in kinds.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query
def manifest_targets(spark, d):
    return dependencies.manifest_targets(a.bare_manifests(spark, d)).select("project", "name", "version")


def _targets(spark, d):
    return dependencies.distinct_targets(dependencies.pnpm_targets(a.pnpm_lockfiles(spark, d)))


@query
def distinct_targets(spark, d):
    return _targets(spark, d)


@query
def limited_targets(spark, d):
    return dependencies.limit_targets(_targets(spark, d), LIMIT)


@query
def package_specs(spark, d):
    t = _targets(spark, d)
    spec = fx.package_spec("name", "version")
    name, version = fx.split_spec(spec)
    return t.select("project", spec.alias("spec"), name.alias("spec_name"), version.alias("spec_version"))


def _package_targets(spark, d):
    number = F.regexp_extract("name", r"(\d+)$", 1)
    return _targets(spark, d).withColumn("package_name", F.concat(F.lit("pkg-"), number))


@query
def batch_outcomes(spark, d):
    return dependencies.batch_outcomes(_package_targets(spark, d), a.run_bounds(spark, d))


@query
def dependency_risk(spark, d):
    return dependencies.dependency_risk(_package_targets(spark, d), rules.verdicts(a.syscalls(spark, d)))


# ------------------------------------------------------------ lineage
@query
def marker_roots(spark, d):
    return lineage.marker_roots(a.processes(spark, d), [])


def _tracked(spark, d, strict_time=False):
    p = a.processes(spark, d)
    return lineage.descendant_pids(p, lineage.marker_roots(p, []), [], strict_time)


@query
def descendant_pids(spark, d):
    return _tracked(spark, d).select("pid")


@query
def descendant_pids_strict(spark, d):
    return _tracked(spark, d, strict_time=True)


@query
def descendant_pids_by_host(spark, d):
    """Two hosts with the same process ids."""
    p = a.host_processes(spark, d)
    return lineage.descendant_pids(p, lineage.marker_roots(p, ["host"]), ["host"])


@query
def descendant_pids_reused(spark, d):
    """Every process id is used again and again."""
    p = a.reused_processes(spark, d)
    return lineage.descendant_pids(p, lineage.marker_roots(p, ["host"]), ["host"], strict_time=True)


@query
def scoped_events(spark, d):
    p = a.processes(spark, d)
    return lineage.scope_events(p, _tracked(spark, d), []).select("pid", "host", "exec_file")


@query
def tracked_pid_count(spark, d):
    hosts = a.processes(spark, d).select("pid", "host")
    return lineage.tracked_pid_count(_tracked(spark, d).join(hosts, "pid"), ["host"])


@query
def attributed_events(spark, d):
    return lineage.attribute_containers(a.syscalls(spark, d), a.cgroup_lines(spark, d), []).select("seq", "pid", "container_id")


@query
def namespace_siblings(spark, d):
    return lineage.namespace_siblings(a.processes(spark, d), packs.MARKER_FILE)


# ------------------------------------------------------------ narrative
@query
def triage_route(spark, d):
    return narrative.triage_route(_merged(spark, d))


@query
def process_digest(spark, d):
    return narrative.process_digest(a.syscalls(spark, d)).select("detonation_id", "position", "line")


@query
def file_digest(spark, d):
    return narrative.file_digest(a.syscalls(spark, d, by_user=True)).select("detonation_id", "position", "unique_files", "line")


@query
def connection_digest(spark, d):
    return narrative.connection_digest(a.syscalls(spark, d))


@query
def deletion_digest(spark, d):
    return narrative.deletion_digest(a.syscalls(spark, d))


@query
def finding_digest(spark, d):
    v = a.syscalls(spark, d)
    return narrative.finding_digest(rules.findings(v), rules.verdicts(v)).select("detonation_id", "severity_rank", "phase", "line")


@query
def analysis_prompts(spark, d):
    v = a.syscalls(spark, d)
    return narrative.analysis_prompts(v, cut_lineage(rules.findings(v)), cut_lineage(rules.verdicts(v)))


@query
def analysis_prompt_parts(spark, d):
    """The same prompts with few lines each."""
    v = a.syscalls(spark, d)
    return narrative.analysis_prompts(v, cut_lineage(rules.findings(v)), cut_lineage(rules.verdicts(v)), PART_LINES)


@query
def attack_chain_prompts(spark, d):
    v = a.syscalls(spark, d)
    return narrative.attack_chain_prompts(v, cut_lineage(rules.findings(v)), cut_lineage(rules.verdicts(v)))


@query
def parsed_responses(spark, d):
    rows = narrative.parse_responses(a.responses(spark, d))
    return rows.withColumn("findings", F.coalesce(F.size("findings"), F.lit(-1)))


_VERDICT = ("detonation_id", "threat_score", "risk_level", "recommendation", "analysis_method", "events_analyzed", "finding_count")


@query
def merged_responses(spark, d):
    return narrative.merge_responses(_merged(spark, d), a.responses(spark, d)).select(*_VERDICT)


@query
def merged_chains(spark, d):
    refined = narrative.merge_responses(_merged(spark, d), a.responses(spark, d))
    out = narrative.merge_attack_chains(refined, a.chain_responses(spark, d))
    return out.select("detonation_id", "threat_score", "analysis_method", "executive_summary", F.size("attack_chain").alias("stages"))


# ------------------------------------------------------------ reports
@query
def top_processes(spark, d):
    return telemetry.top_processes(a.syscalls(spark, d, by_user=True), 15).select("detonation_id", "position", "pid", "process_name", "filename", "more")


def _scored(spark, d):
    v = a.syscalls(spark, d)
    ended = v.groupBy("detonation_id").agg(F.max("captured_at").alias("ended_at"))
    return v, rules.verdicts(v).join(ended, "detonation_id")


def _reports(spark, d, **options):
    v, scored = _scored(spark, d)
    return reports.report_documents(scored, rules.findings(v), analyzed_at=F.col("ended_at"), **options)


@query
def report_index(spark, d):
    return reports.verdict_index(_scored(spark, d)[1], F.col("ended_at"))


@query
def document_index(spark, d):
    """The index of written documents, whose parts are added up."""
    return reports.report_index(_reports(spark, d, limit=PART_FINDINGS))


@query
def report_parts(spark, d):
    """Documents of few findings each: sizes, and the ends of every part."""
    docs = _reports(spark, d, limit=PART_FINDINGS)
    end = lambda k, f: F.try_element_at("findings", F.lit(k))[f]
    return docs.select("report_id", "part_no", F.size("findings").alias("findings"), end(1, "evidence").alias("first_evidence"),
                       end(-1, "evidence").alias("last_evidence"), end(-1, "severity").alias("last_severity"), "threat_score", "events_analyzed")


@query
def report_findings(spark, d):
    """The nested findings of the documents, unfolded again with their position."""
    docs = _reports(spark, d).select("report_id", F.posexplode("findings").alias("position", "f"))
    return docs.select("report_id", "position", "f.severity", "f.evidence")


@query
def report_by_id(spark, d):
    users = a.table(spark, d, "events").select("user_id").distinct()
    wanted = users.select(F.concat(F.lit("api/reports/det-"), F.col("user_id").cast("string"), F.lit("-2"),
                                   F.when(F.col("user_id") % 2 == 0, ".json").otherwise("")).alias("request"))
    v = reports.requested_runs(a.syscalls(spark, d), wanted)
    docs = reports.report_documents(rules.verdicts(v), rules.findings(v), F.lit(a.AS_OF).cast("timestamp"))
    return reports.report_by_id(docs, wanted).select("report_id", "package_name", "threat_score", "risk_level")


@query
def run_forensics(spark, d):
    return reports.run_forensics(a.syscalls(spark, d), a.run_bounds(spark, d))


# ------------------------------------------------------------ sessions
@query
def session_list(spark, d):
    return sessions.sessionize(a.syscalls(spark, d, by_user=True), SESSION_GAP_SECONDS)


@query
def session_verdicts(spark, d):
    """Each session scored on its own."""
    v = a.syscalls(spark, d, by_user=True)
    found = sessions.sessionize(v, SESSION_GAP_SECONDS)
    per_session = sessions.attach_sessions(v, found, SESSION_GAP_SECONDS)
    return rules.verdicts(per_session, keys=("detonation_id", "session_start")).select(
        "detonation_id", "session_start", "threat_score", "events_analyzed", "finding_count")


def _streamed(spark, d, close_all):
    """The events in three batches that are dealt out by hash, so most come late."""
    v = a.syscalls(spark, d, by_user=True)
    tables = stream.VerdictTables.under(spark, f"{scratch_folder(spark)}/stream-{uuid.uuid4().hex}")
    for version in range(3):
        batch = v.filter(F.pmod(F.xxhash64("detonation_id", "seq"), F.lit(3)) == version)
        stream.advance(tables, version, batch, gap_seconds=SESSION_GAP_SECONDS, delay_seconds=STREAM_DELAY_SECONDS,
                       analyzed_at=F.lit(a.AS_OF).cast("timestamp"), close_all=close_all and version == 2)
    return tables


@query
def streamed_sessions(spark, d):
    return stream.closed_sessions(_streamed(spark, d, True))


@query
def active_sessions(spark, d):
    return stream.active_sessions(_streamed(spark, d, False))


@query
def streamed_reports(spark, d):
    docs = stream.current_reports(_streamed(spark, d, True))
    return docs.groupBy("detonation_id", "session_start", "threat_score", "events_analyzed").agg(
        F.sum(F.size("findings")).alias("finding_count"))


@query
def windowed_events(spark, d):
    return telemetry.detonation_window(a.syscalls(spark, d), a.run_bounds(spark, d), CAPTURE_SECONDS).select("detonation_id", "seq", "event_type")


@query
def delivery_audit(spark, d):
    v = a.syscalls(spark, d)
    return telemetry.delivery_audit(v, v.filter(~a.undelivered_flag()))


@query
def undelivered_events(spark, d):
    v = a.syscalls(spark, d)
    return telemetry.undelivered(v, v.filter(~a.undelivered_flag())).select("detonation_id", "seq")
