"""Runtime rule engine: syscall events in, findings and scored verdicts out.

Shape of the plans
------------------
An event is tested against the packs by plain column expressions, so no join
touches the event table.  Every matched rule becomes one (run, kind, key) row;
the first aggregation on (run, kind, key) has map-side partials that collapse
even a run holding most of the data to a handful of rows per task.  Only then
is anything grouped by run.

``verdicts`` needs counts and distinct keys only: its passes over the events are
hash aggregations without text in their buffers.
``findings`` needs the first event's text as evidence and therefore works on
the matched events alone.

``keys`` names the columns that identify a run; streaming passes
("detonation_id", "session_start").
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as fx
from ..functions import packs

RUN = ("detonation_id",)
HIT_TYPES = ("EXECVE", "OPENAT", "CONNECT", "UNLINK")
# detection phases: events in arrival order, then the burst, then connections
PHASE_EVENT, PHASE_BURST, PHASE_CONNECTION = 0, 1, 2
# fixed values: evidence formats
EVIDENCE_SQL = """CASE kind
    WHEN 'exec' THEN concat('execve: ', proc, ' → ', path, ' (PID=', pid, ')')
    WHEN 'file' THEN concat('openat: ', process_name, ' → ', path, ' (PID=', pid, ')')
    WHEN 'unlink' THEN concat('unlinkat: ', process_name, ' deleted ', path, ' (PID=', pid, ')')
    ELSE concat('connect: → ', key) END"""


def _hit(kind: str, key_sql: str) -> str:
    return f"struct('{kind}' AS kind, {key_sql} AS key)"


def exec_hits_sql(pack: Sequence[packs.EventRule] = packs.EXEC_RULES) -> str:
    """Rule names equal to the base name of the file or to the process name."""
    names = fx.sql_list([r.pattern for r in packs.checked(pack)])
    base = "substring_index(path, '/', -1)"
    return (f"array(CASE WHEN {base} IN ({names}) THEN {_hit('exec', base)} END, "
            f"CASE WHEN proc IN ({names}) AND proc <> {base} THEN {_hit('exec', 'proc')} END)")


def _file_rule_sql(rule: packs.EventRule) -> str:
    fires = f"contains(path, {fx.sql_text(rule.pattern)})"
    if rule.exempt_names:
        fires += f" AND proc NOT IN ({fx.sql_list(rule.exempt_names)})"
    for prefix in rule.exempt_prefixes:
        fires += f" AND NOT startswith(proc, {fx.sql_text(prefix)})"
    return f"CASE WHEN {fires} THEN {_hit('file', fx.sql_text(rule.pattern))} END"


def file_hits_sql(pack: Sequence[packs.EventRule] = packs.FILE_RULES,
                  safe_prefixes: Sequence[str] = packs.SAFE_PREFIXES) -> str:
    """Rules whose pattern occurs in the opened path, outside the safe prefixes."""
    safe = " OR ".join(f"startswith(path, {fx.sql_text(p)})" for p in safe_prefixes) or "false"
    some = " OR ".join(f"contains(path, {fx.sql_text(r.pattern)})" for r in packs.checked(pack)) or "false"
    slots = ", ".join(_file_rule_sql(r) for r in pack)
    return f"CASE WHEN NOT ({safe}) AND ({some}) THEN array({slots}) END"


def event_hits(exec_pack=packs.EXEC_RULES, file_pack=packs.FILE_RULES) -> Column:
    """All (kind, key) hits of one prepared event as an array with NULL slots."""
    external = fx.is_external("connect_ip") & ~fx.is_known_cdn("connect_ip")
    connection = F.concat(fx.ipv4("connect_ip"), F.lit(":"), F.col("connect_port").cast("string"))
    kind = F.col("event_type")
    return (
        F.when(kind == "EXECVE", F.expr(exec_hits_sql(exec_pack)))
        .when(kind == "OPENAT", F.expr(file_hits_sql(file_pack)))
        .when((kind == "UNLINK") & (F.col("path") != ""), F.expr(f"array({_hit('unlink', 'path')})"))
        .when((kind == "CONNECT") & external, F.array(F.struct(F.lit("connect").alias("kind"), connection.alias("key"))))
    )


def prepare(events: DataFrame) -> DataFrame:
    """Add the stripped file (``path``) and process (``proc``) names."""
    return events.withColumns({"path": fx.strip_ws("filename"), "proc": fx.strip_ws("process_name")})


def hit_events(events: DataFrame, keys: Sequence[str] = RUN,
               exec_pack=packs.EXEC_RULES, file_pack=packs.FILE_RULES) -> DataFrame:
    """One row per (event, fired rule)."""
    kept = [*keys, "seq", "pid", "process_name", "path", "proc", "connect_ip", "connect_port"]
    return (
        prepare(events.filter(F.col("event_type").isin(*HIT_TYPES)))
        .select(*kept, F.explode_outer(event_hits(exec_pack, file_pack)).alias("hit"))
        .filter(F.col("hit").isNotNull())
        .select(*kept, "hit.kind", "hit.key")
    )


def match_exec_rules(events: DataFrame, pack=packs.EXEC_RULES) -> DataFrame:
    """Every (event, exec rule) pair that fires."""
    return _matches(events, "EXECVE", exec_hits_sql(pack))


def match_file_rules(events: DataFrame, pack=packs.FILE_RULES) -> DataFrame:
    """Every (event, file rule) pair that fires."""
    return _matches(events, "OPENAT", file_hits_sql(pack))


def _matches(events: DataFrame, event_type: str, hits_sql: str) -> DataFrame:
    rows = prepare(events.filter(F.col("event_type") == event_type)).select(
        "detonation_id", "seq", F.explode_outer(F.expr(hits_sql)).alias("hit"))
    return rows.filter(F.col("hit").isNotNull()).select("detonation_id", "seq", F.col("hit.key").alias("pattern"))


def first_hits(events: DataFrame, keys: Sequence[str] = RUN, **pack) -> DataFrame:
    """De-duplicated hits: per (run, kind, key) the first event in arrival order."""
    first = F.struct("seq", "pid", "process_name", "path", "proc", "connect_ip", "connect_port")
    return (
        hit_events(events, keys, **pack)
        .groupBy(*keys, "kind", "key").agg(F.min_by(first, "seq").alias("first"))
        .select(*keys, "kind", "key", "first.*")
    )


def exec_burst(events: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Runs with many EXECVEs: the points and the distinct unexpected processes.

    Processes are made distinct before they are gathered, so the list holds
    names and never events.
    """
    names = (
        events.filter(F.col("event_type") == "EXECVE")
        .groupBy(*keys, fx.strip_ws("process_name").alias("process")).agg(F.count("*").alias("n"))
    )
    odd = F.when(fx.is_nonstandard_process("process"), F.col("process"))
    totals = names.groupBy(*keys).agg(
        F.sum("n").alias("execve_count"), F.array_sort(F.collect_list(odd)).alias("odd"))
    extra = F.col("execve_count") - packs.EXPECTED_EXECS
    return totals.filter(F.col("execve_count") > packs.EXPECTED_EXECS + packs.BURST_SLACK).select(
        *keys, "execve_count", extra.alias("extra"), burst_points("execve_count").alias("points"),
        F.when(F.size("odd") > 0, F.array_join("odd", ", ")).otherwise("none identified").alias("processes"))


def burst_points(execve_count: Column | str) -> Column:
    n = F.col(execve_count) if isinstance(execve_count, str) else execve_count
    extra = n - packs.EXPECTED_EXECS
    return F.when(n > packs.EXPECTED_EXECS + packs.BURST_SLACK,
                  F.least(extra * 2, F.lit(packs.BURST_MAX_POINTS))).otherwise(0).cast("long")


def _rule_table(spark, exec_pack, file_pack) -> DataFrame:
    exec_pack, file_pack = packs.first_per_pattern(exec_pack), packs.first_per_pattern(file_pack)
    return packs.pack_table(spark, exec_pack, "exec").unionByName(packs.pack_table(spark, file_pack, "file"))


def findings(events: DataFrame, keys: Sequence[str] = RUN,
             exec_pack=packs.EXEC_RULES, file_pack=packs.FILE_RULES) -> DataFrame:
    """Findings as rows.  (severity_rank, phase, order_key, ordinal) is the order
    in which the report lists them."""
    hits = first_hits(events, keys, exec_pack=exec_pack, file_pack=file_pack)
    rules = _rule_table(events.sparkSession, exec_pack, file_pack).withColumnRenamed("pattern", "key")

    def pick(rule_value: str, unlink: str, connect: str) -> Column:
        return F.expr(f"CASE kind WHEN 'unlink' THEN {unlink} WHEN 'connect' THEN {connect} ELSE {rule_value} END")

    name = lambda mitre: F.lit(packs.MITRE_NAMES[mitre])
    event_findings = hits.join(rules, ["kind", "key"], "left").select(
        *keys, "kind", "key",
        F.expr(f"CASE kind WHEN 'connect' THEN {PHASE_CONNECTION} ELSE {PHASE_EVENT} END").alias("phase"),
        F.expr("CASE kind WHEN 'connect' THEN connect_ip ELSE seq END").alias("order_key"),
        pick("ordinal", "0", "connect_port").cast("long").alias("ordinal"),
        pick("points", str(packs.UNLINK_POINTS), str(packs.CONNECTION_POINTS)).cast("long").alias("points"),
        pick("severity", "'HIGH'", "'HIGH'").alias("severity"),
        pick("category", "'anti_forensics'", "'network'").alias("category"),
        pick("rule_text", "concat('Deleted file: ', path)", "concat('Outbound connection to ', key)").alias("description"),
        F.expr(EVIDENCE_SQL).alias("evidence"),
        pick("mitre_id", "'T1070.004'", "'T1071.001'").alias("mitre_id"),
        pick("mitre_name", *[fx.sql_text(packs.MITRE_NAMES[m]) for m in ("T1070.004", "T1071.001")]).alias("mitre_name"),
    )
    bursts = exec_burst(events, keys).select(
        *keys, F.lit("burst").alias("kind"), F.lit("burst").alias("key"), F.lit(PHASE_BURST).alias("phase"),
        F.lit(0).cast("long").alias("order_key"), F.lit(0).cast("long").alias("ordinal"), "points",
        F.lit("MEDIUM").alias("severity"), F.lit("suspicious_activity").alias("category"),
        F.concat(F.lit("Many processes started: "), F.col("execve_count").cast("string"), F.lit(" execve calls, "),
                 F.col("extra").cast("string"), F.lit(" more than expected")).alias("description"),
        F.concat(F.lit("Non-standard processes: "), F.col("processes")).alias("evidence"),
        F.lit("T1106").alias("mitre_id"), name("T1106").alias("mitre_name"),
    )
    return event_findings.unionByName(bursts).withColumn("severity_rank", fx.severity_rank("severity"))


TYPE_COUNTS = {
    "execve_count": "EXECVE", "openat_count": "OPENAT", "connect_count": "CONNECT",
    "write_count": "WRITE", "unlink_count": "UNLINK",
}


def event_type_counts(events: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Events per run, in total and for the five known types."""
    return events.groupBy(*keys).agg(
        F.count("*").alias("events_analyzed"),
        *type_counts())


def type_counts() -> list[Column]:
    return [F.expr(f"count_if(event_type = '{t}') AS {n}") for n, t in TYPE_COUNTS.items()]


def _points_sql(exec_pack, file_pack) -> str:
    """Points of a (kind, key) pair as an expression over the packs."""
    def lookup(pack):
        rows = ", ".join(f"{fx.sql_text(r.pattern)}, {int(r.points)}" for r in packs.first_per_pattern(packs.checked(pack)))
        return f"coalesce(try_element_at(map({rows}), key), 0)" if rows else "0"

    return (f"CASE kind WHEN 'exec' THEN {lookup(exec_pack)} WHEN 'file' THEN {lookup(file_pack)} "
            f"WHEN 'unlink' THEN {packs.UNLINK_POINTS} WHEN 'connect' THEN {packs.CONNECTION_POINTS} ELSE 0 END")


def verdicts(events: DataFrame, keys: Sequence[str] = RUN,
             exec_pack=packs.EXEC_RULES, file_pack=packs.FILE_RULES) -> DataFrame:
    """Scored verdict per run.

    Two column-pruned passes, both hash aggregations with map-side partials:
    the counts read four columns of all events, the distinct (kind, key) hits
    read the matched events.  Both shrink to rows per run and meet in one
    small aggregation.
    """
    counts = ("events_analyzed", *TYPE_COUNTS)
    seen = events.groupBy(*keys, "package_name").agg(
        F.max("seq").alias("last_seq"), F.count("*").alias("events_analyzed"), *type_counts())
    hits = hit_events(events, keys, exec_pack, file_pack).select(*keys, "kind", "key").distinct()
    points = hits.groupBy(*keys).agg(
        F.sum(F.expr(_points_sql(exec_pack, file_pack))).cast("long").alias("rule_points"), F.count("*").alias("rule_findings"))
    rows = seen.unionByName(points, allowMissingColumns=True)
    per_run = rows.groupBy(*keys).agg(
        F.max_by("package_name", "last_seq").alias("package_name"),
        *[F.expr(f"coalesce(sum({c}), 0) AS {c}") for c in ("rule_points", "rule_findings", *counts)])
    burst = burst_points("execve_count")
    score = F.least(F.col("rule_points") + burst, F.lit(100)).cast("long")
    risk = fx.risk_band("threat_score")
    return per_run.withColumn("threat_score", score).select(
        *keys, "package_name", "threat_score", risk.alias("risk_level"),
        fx.recommendation(risk).alias("recommendation"), F.lit("rules").alias("analysis_method"), *counts,
        (F.col("rule_findings") + F.when(burst > 0, 1).otherwise(0)).alias("finding_count"))


def run_packages(events: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """The package of each run, that of its last event as in ``verdicts``."""
    return events.groupBy(*keys).agg(F.max_by("package_name", "seq").alias("package_name"))


def unlink_findings(events: DataFrame) -> DataFrame:
    return first_hits(events.filter(F.col("event_type") == "UNLINK")).select(
        "detonation_id", F.col("key").alias("filename"), F.col("seq").alias("order_key"),
        F.lit(packs.UNLINK_POINTS).alias("points"))


def connection_findings(events: DataFrame) -> DataFrame:
    """Distinct external (ip, port) per run, known delivery network left out."""
    return (
        events.filter((F.col("event_type") == "CONNECT") & fx.is_external("connect_ip") & ~fx.is_known_cdn("connect_ip"))
        .select("detonation_id", fx.ipv4("connect_ip").alias("ip"), "connect_port").distinct()
        .withColumn("points", F.lit(packs.CONNECTION_POINTS)))


def mitre_summary(found: DataFrame, runs: DataFrame) -> DataFrame:
    """Findings, points and packages per technique."""
    return _summary(found, runs, ["mitre_id", "mitre_name"])


def category_summary(found: DataFrame, runs: DataFrame) -> DataFrame:
    return _summary(found, runs, ["category"])


def _summary(found: DataFrame, runs: DataFrame, by: list[str]) -> DataFrame:
    # A technique can own most findings: first collapse to (technique, run) and
    # (technique, package), both with map-side partials, and only then by technique.
    per_run = found.groupBy(*by, "detonation_id").agg(F.count("*").alias("n"), F.sum("points").alias("points"))
    per_package = (
        per_run.join(runs.select("detonation_id", "package_name"), "detonation_id")
        .groupBy(*by, "package_name").agg(F.sum("n").alias("n"), F.sum("points").alias("points")))
    return per_package.groupBy(*by).agg(
        F.sum("n").alias("findings"), F.sum("points").alias("points"), F.count("*").alias("packages"))
