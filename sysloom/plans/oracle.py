"""The registered queries as plain SQL over the same tables, written
independently of the Spark plans (joins and windows instead of expressions)."""

from __future__ import annotations

from ..functions import packs
from ..operators import narrative
from . import adapters as a
from . import adapter_sql as s

t = s.text
IP = "((connect_ip & 255) || '.' || ((connect_ip >> 8) & 255) || '.' || ((connect_ip >> 16) & 255) || '.' || ((connect_ip >> 24) & 255))"
BASE = "regexp_extract({}, '[^/]*$')"
EXTERNAL = f"(NOT starts_with({IP}, '127.') AND {IP} <> '0.0.0.0')"


def _starts(column: str, prefixes) -> str:
    return "(" + " OR ".join(f"starts_with({column}, {t(p)})" for p in prefixes) + ")"


def _contains(column: str, needles) -> str:
    return "(" + " OR ".join(f"contains({column}, {t(n)})" for n in needles) + ")"


def _in(values) -> str:
    return "(" + ", ".join(t(v) for v in values) + ")"


def _rules_table(pack, kind: str) -> str:
    rows = ", ".join(
        f"({t(kind)}, {i}, {t(getattr(r, 'pattern', None) or r.regex)}, {getattr(r, 'points', 0)}, {t(r.severity)}, {t(r.category)}, "
        f"{t(r.description)}, {t(r.mitre_id)}, {t(packs.MITRE_NAMES[r.mitre_id])}, {t(getattr(r, 'needle', ''))})"
        for i, r in enumerate(pack, 1))
    return f"SELECT * FROM (VALUES {rows}) AS r(kind, ordinal, pattern, points, severity, category, rule_text, mitre_id, mitre_name, needle)"


def _case(column: str, mapping: dict, default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {t(k)} THEN {v}" for k, v in mapping.items()) + f" ELSE {default} END"


RANK = _case("severity", {v: i for i, v in enumerate(packs.SEVERITIES)}, "5")
BAND = "CASE WHEN {0} >= 60 THEN 'MALICIOUS' WHEN {0} >= 25 THEN 'SUSPICIOUS' ELSE 'SAFE' END"
ADVICE = "CASE WHEN {0} >= 60 THEN " + t(packs.RECOMMENDATIONS["MALICIOUS"]) + " WHEN {0} >= 25 THEN " + t(
    packs.RECOMMENDATIONS["SUSPICIOUS"]) + " ELSE " + t(packs.RECOMMENDATIONS["SAFE"]) + " END"
NPMRC = next(r for r in packs.FILE_RULES if r.exempt_names)


def _hits(v: str) -> str:
    keep = "detonation_id, seq, pid, process_name, filename, connect_ip, connect_port"
    return f"""
SELECT {keep}, 'exec' AS kind, pattern AS key FROM {v}, exec_rules
 WHERE event_type='EXECVE' AND (pattern = {BASE.format('trim(filename)')} OR pattern = trim(process_name))
UNION ALL SELECT {keep}, 'file', pattern FROM {v}, file_rules
 WHERE event_type='OPENAT' AND NOT {_starts('trim(filename)', packs.SAFE_PREFIXES)} AND contains(trim(filename), pattern)
 AND NOT (pattern = {t(NPMRC.pattern)} AND (trim(process_name) IN {_in(NPMRC.exempt_names)} OR starts_with(trim(process_name), 'npm install')))
UNION ALL SELECT {keep}, 'unlink', trim(filename) FROM {v} WHERE event_type='UNLINK' AND trim(filename) <> ''
UNION ALL SELECT {keep}, 'connect', {IP} || ':' || connect_port FROM {v}
 WHERE event_type='CONNECT' AND {EXTERNAL} AND NOT starts_with({IP}, '104.16.')"""


def _bursts(v: str) -> str:
    return f"""
SELECT detonation_id, n AS execve_count, n-6 AS extra, CAST(least(2*(n-6), 20) AS BIGINT) AS points,
 coalesce(names, 'none identified') AS processes
FROM (SELECT detonation_id, count(*) AS n, string_agg(DISTINCT trim(process_name), ', ' ORDER BY trim(process_name))
  FILTER (WHERE trim(process_name) NOT IN {_in(packs.EXPECTED_PROCESSES)}) AS names
 FROM {v} WHERE event_type='EXECVE' GROUP BY detonation_id) WHERE n > 11"""


def _found(hits: str, bursts: str) -> str:
    name = lambda m: t(packs.MITRE_NAMES[m])
    return f"""
SELECT f.detonation_id, f.kind, f.key,
 CAST(CASE f.kind WHEN 'unlink' THEN 15 WHEN 'connect' THEN 20 ELSE r.points END AS BIGINT) AS points,
 CASE WHEN f.kind IN ('unlink','connect') THEN 'HIGH' ELSE r.severity END AS severity,
 CASE f.kind WHEN 'unlink' THEN 'anti_forensics' WHEN 'connect' THEN 'network' ELSE r.category END AS category,
 CASE f.kind WHEN 'unlink' THEN 'Deleted file: ' || f.key WHEN 'connect' THEN 'Outbound connection to ' || f.key ELSE r.rule_text END AS description,
 CASE f.kind WHEN 'exec' THEN 'execve: ' || trim(process_name) || ' → ' || trim(filename) || ' (PID=' || pid || ')'
  WHEN 'file' THEN 'openat: ' || process_name || ' → ' || trim(filename) || ' (PID=' || pid || ')'
  WHEN 'unlink' THEN 'unlinkat: ' || process_name || ' deleted ' || trim(filename) || ' (PID=' || pid || ')'
  ELSE 'connect: → ' || f.key END AS evidence,
 CASE f.kind WHEN 'unlink' THEN 'T1070.004' WHEN 'connect' THEN 'T1071.001' ELSE r.mitre_id END AS mitre_id,
 CASE f.kind WHEN 'unlink' THEN {name('T1070.004')} WHEN 'connect' THEN {name('T1071.001')} ELSE r.mitre_name END AS mitre_name,
 CASE WHEN f.kind = 'connect' THEN 2 ELSE 0 END AS phase,
 CASE WHEN f.kind = 'connect' THEN connect_ip ELSE seq END AS order_key,
 CAST(CASE f.kind WHEN 'connect' THEN connect_port WHEN 'unlink' THEN 0 ELSE r.ordinal END AS BIGINT) AS ordinal
FROM (SELECT *, row_number() OVER (PARTITION BY detonation_id, kind, key ORDER BY seq) AS rn FROM {hits}) f
LEFT JOIN (SELECT * FROM exec_rules UNION ALL SELECT * FROM file_rules) r ON r.kind = f.kind AND r.pattern = f.key
WHERE rn = 1
UNION ALL SELECT detonation_id, 'burst', 'burst', points, 'MEDIUM', 'suspicious_activity',
 'Many processes started: ' || execve_count || ' execve calls, ' || extra || ' more than expected',
 'Non-standard processes: ' || processes, 'T1106', {name('T1106')}, 1, 0, 0 FROM {bursts}"""


def _verdicts(v: str, found: str) -> str:
    return f"""
SELECT detonation_id, package_name, threat_score, {BAND.format('threat_score')} AS risk_level, {ADVICE.format('threat_score')} AS recommendation,
 'rules' AS analysis_method, events_analyzed, execve_count, openat_count, connect_count, write_count, unlink_count, finding_count
FROM (SELECT c.*, CAST(least(coalesce(points, 0), 100) AS BIGINT) AS threat_score, coalesce(n, 0) AS finding_count FROM
 (SELECT detonation_id, arg_max(package_name, seq) AS package_name, count(*) AS events_analyzed,
  count(*) FILTER (WHERE event_type='EXECVE') AS execve_count, count(*) FILTER (WHERE event_type='OPENAT') AS openat_count,
  count(*) FILTER (WHERE event_type='CONNECT') AS connect_count, count(*) FILTER (WHERE event_type='WRITE') AS write_count,
  count(*) FILTER (WHERE event_type='UNLINK') AS unlink_count FROM {v} GROUP BY detonation_id) c
 LEFT JOIN (SELECT detonation_id, sum(points) AS points, count(*) AS n FROM {found} GROUP BY detonation_id) USING (detonation_id))"""


AGE = f"CAST(floor((epoch_us(TIMESTAMP '{a.AS_OF}') - published_us) / 86400000000.0) AS BIGINT)"
_NEAR = f"""
SELECT registry_key, arg_min(p, distance || p) AS target, CAST(min(distance) AS BIGINT) AS distance FROM
 (SELECT registry_key, p, levenshtein(lower(package_name), lower(p)) AS distance FROM registry, unnest({s.array(packs.POPULAR_PACKAGES)}) AS u(p)
  WHERE status = 'ok' AND package_name NOT IN {_in(packs.POPULAR_PACKAGES)})
WHERE distance BETWEEN 1 AND 2 GROUP BY registry_key"""
_KNOWN_NAMES = """
SELECT DISTINCT package_name || unnest([substr(md5(CAST(part_key AS VARCHAR)), 1, 1), substr(md5(CAST(part_key AS VARCHAR)), 2, 2)]) AS name FROM registry"""
_NEAR_TABLE = """
SELECT registry_key, arg_min(name, distance || name) AS target, CAST(min(distance) AS BIGINT) AS distance FROM
 (SELECT registry_key, name, levenshtein(lower(package_name), lower(name)) AS distance FROM registry, known_names
  WHERE status = 'ok' AND package_name NOT IN (SELECT name FROM known_names) AND abs(len(package_name) - len(name)) <= 2)
WHERE distance BETWEEN 1 AND 2 GROUP BY registry_key"""
_SIGNALS = f"""
SELECT registry_key, 1 AS ordinal, 'MEDIUM' AS severity, 'Package ''' || package_name || ''' is not in the registry' AS description,
 'Unpublished: private or brand-new' AS evidence FROM registry WHERE status = 'error'
UNION ALL SELECT registry_key, 2, CASE WHEN {AGE} < 7 THEN 'HIGH' ELSE 'MEDIUM' END, 'Latest version published ' || {AGE} || ' days ago',
 'Version ' || latest_version FROM registry WHERE status = 'ok' AND {AGE} < 30
UNION ALL SELECT registry_key, 3, CASE WHEN weekly_downloads < 100 THEN 'HIGH' ELSE 'LOW' END, 'Few downloads: ' || weekly_downloads || ' a week',
 'Well-used packages have 10,000 and more' FROM registry WHERE status = 'ok' AND weekly_downloads < 1000
UNION ALL SELECT registry_key, 4, 'LOW', 'At most one maintainer', 'Maintainer: ' || CASE n_maintainers WHEN 0 THEN 'unknown' ELSE 'm0' END
 FROM registry WHERE status = 'ok' AND n_maintainers <= 1
UNION ALL SELECT registry_key, 5, 'HIGH', 'Package name ''' || package_name || ''' is close to ''' || target || '''', 'Levenshtein distance: ' || distance
 FROM registry JOIN near USING (registry_key)"""
_MERGED = """
SELECT v.* EXCLUDE (threat_score, finding_count), CAST(least(threat_score + coalesce(p, 0), 100) AS BIGINT) AS threat_score,
 coalesce(n, 0) AS metadata_findings, finding_count + coalesce(n, 0) AS finding_count
FROM scored v LEFT JOIN (SELECT registry_key, count(*) AS n,
 sum(CASE severity WHEN 'HIGH' THEN 5 WHEN 'CRITICAL' THEN 5 WHEN 'MEDIUM' THEN 2 ELSE 0 END) AS p FROM signals GROUP BY registry_key) g
 ON g.registry_key = v.package_name"""

_SCANNABLE = "(" + " OR ".join(f"suffix(path, '{x}')" for x in packs.SCANNABLE_SUFFIXES) + ") AND NOT contains(path, 'node_modules/')"
_SCAN = f"""
SELECT package, path, r.ordinal AS rule_no, line_no, severity, category, rule_text AS description,
 path || ':' || line_no || ' → ' || left(trim(line), 80) AS evidence, mitre_id, mitre_name
FROM (SELECT package, path, u.line, u.line_no, r.ordinal, row_number() OVER (PARTITION BY package, path, r.ordinal ORDER BY u.line_no) AS rn
 FROM (SELECT package, path, unnest(lines) AS line, unnest(range(1, len(lines)+1)) AS line_no
   FROM (SELECT package, path, string_split(content, chr(10)) AS lines FROM files WHERE {_SCANNABLE})) u
 JOIN code_rules r ON contains(u.line, r.needle) AND regexp_matches(u.line, r.pattern)) f
JOIN code_rules r USING (ordinal) WHERE rn = 1"""
_HOOKS = """
SELECT package, hook, script FROM (VALUES ('postinstall', 0, 'node p.js'), ('install', 2, 'make'), ('preinstall', 2, 'sh pre.sh')) AS h(hook, n, script)
JOIN (SELECT package, CASE WHEN contains(content, 'postinstall') THEN 0 WHEN contains(content, 'pre.sh') THEN 2 ELSE 9 END AS n FROM manifests) USING (n)"""
_SCANNED = f"""
SELECT package, path, rule_no, severity, {RANK} AS severity_rank, evidence FROM scan
UNION ALL SELECT package, 'package.json', 0, 'HIGH', 1, 'scripts.' || hook || ' = "' || script || '"' FROM hooks"""

_PNPM = """
SELECT DISTINCT project, pnpm_key AS lock_key, regexp_extract(bare, '^(.+)@([^@]*)$', 1) AS name, regexp_extract(bare, '^(.+)@([^@]*)$', 2) AS version
FROM (SELECT project, pnpm_key, regexp_replace(regexp_replace(pnpm_key, '^/', ''), '[(].*$', '') AS bare FROM locks)"""
_TARGETS = "SELECT project, name, arg_max(version, lock_key) AS version FROM pnpm GROUP BY project, name"
_PKG_TARGETS = "SELECT *, 'pkg-' || regexp_extract(name, '([0-9]+)$', 1) AS package_name FROM targets"
_ROOTS = f"SELECT ppid AS pid, min(fork_ts) AS since FROM procs WHERE exec_file = '{packs.MARKER_FILE}' AND ppid IS NOT NULL GROUP BY ppid"
# an ancestor walk: every process climbs to the top of its tree
_CLIMB = """
SELECT pid, ppid AS anc, fork_ts AS below, true AS valid FROM procs WHERE ppid IS NOT NULL
UNION ALL SELECT c.pid, p.ppid, p.fork_ts, c.valid AND p.fork_ts <= c.below FROM climb c JOIN procs p ON p.pid = c.anc WHERE p.ppid IS NOT NULL"""
_TRACKED = "SELECT pid FROM roots UNION SELECT c.pid FROM climb c JOIN roots r ON r.pid = c.anc"
_TRACKED_STRICT = """
SELECT pid, min(since) AS since FROM (SELECT pid, since FROM roots UNION ALL
 SELECT c.pid, p.fork_ts FROM climb c JOIN roots r ON r.pid = c.anc JOIN procs p ON p.pid = c.pid WHERE c.valid AND r.since <= c.below) GROUP BY pid"""

_SESSIONS = """
SELECT detonation_id, min(captured_at) AS session_start, max(captured_at) AS session_last, count(*) AS events, arg_max(package_name, seq) AS package_name
FROM (SELECT *, sum(opens) OVER (PARTITION BY detonation_id ORDER BY captured_at, seq ROWS UNBOUNDED PRECEDING) AS session FROM
 (SELECT *, CASE WHEN captured_at - lag(captured_at) OVER (PARTITION BY detonation_id ORDER BY captured_at, seq) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM v1u))
GROUP BY detonation_id, session"""

_GOOD = "m % 7 IN (1, 2, 4, 5, 6)"
_REFINED = f"""
SELECT v.detonation_id, events_analyzed,
 CASE WHEN asked AND good THEN CASE WHEN m % 7 IN (1, 2) THEN 42 WHEN m % 7 = 4 THEN 100 WHEN m % 7 = 5 THEN 0 ELSE 20 END ELSE threat_score END AS threat_score,
 CASE WHEN asked AND good THEN CASE WHEN m % 7 IN (1, 2) THEN 'SUSPICIOUS' WHEN m % 7 = 4 THEN 'MALICIOUS' WHEN m % 7 = 5 THEN 'SUSPICIOUS' ELSE 'SAFE' END ELSE risk_level END AS risk_level,
 CASE WHEN asked AND good THEN 'check it' ELSE recommendation END AS recommendation,
 CASE WHEN NOT asked THEN 'rules' WHEN good THEN 'hybrid (rules + LLM)' WHEN m % 7 = 0 THEN 'rules only (LLM error: no answer)'
  ELSE 'rules only (LLM error: invalid answer)' END AS analysis_method,
 CASE WHEN asked AND good THEN CASE WHEN m % 7 = 6 THEN 1 ELSE 2 END ELSE finding_count END AS finding_count, m
FROM (SELECT *, threat_score BETWEEN 11 AND 59 AS asked FROM merged) v
JOIN (SELECT detonation_id, m, {_GOOD} AS good FROM runs) USING (detonation_id)"""

_PROCESS_KEYS = "SELECT detonation_id, process_name, filename, min(seq) AS seq, arg_min(pid, seq) AS pid FROM v1 WHERE event_type='EXECVE' GROUP BY ALL"
_FILE_KEYS = f"""SELECT detonation_id, filename, min(seq) AS seq, arg_min(process_name, seq) AS process_name FROM v1u
 WHERE event_type='OPENAT' AND NOT {_starts('filename', packs.DIGEST_SAFE_PREFIXES)} GROUP BY detonation_id, filename"""

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    **s.VIEWS,
    "exec_rules": ((), _rules_table(packs.EXEC_RULES, "exec")),
    "file_rules": ((), _rules_table(packs.FILE_RULES, "file")),
    "code_rules": ((), _rules_table(packs.CODE_RULES, "code")),
    "custom_rules": ((), _rules_table(a.CUSTOM_RULES, "code")),
    "hits": (("v1", "exec_rules", "file_rules"), _hits("v1")),
    "hits_u": (("v1u", "exec_rules", "file_rules"), _hits("v1u")),
    "bursts": (("v1",), _bursts("v1")),
    "bursts_u": (("v1u",), _bursts("v1u")),
    "found": (("hits", "bursts"), _found("hits", "bursts")),
    "found_u": (("hits_u", "bursts_u"), _found("hits_u", "bursts_u")),
    "scored": (("v1", "found"), _verdicts("v1", "found")),
    "scored_u": (("v1u", "found_u"), _verdicts("v1u", "found_u")),
    "near": (("registry",), _NEAR),
    "known_names": (("registry",), _KNOWN_NAMES),
    "near_table": (("registry", "known_names"), _NEAR_TABLE),
    "signals": (("registry", "near"), _SIGNALS),
    "signals_table": (("registry", "near_table"), _SIGNALS.replace("JOIN near ", "JOIN near_table ")),
    "merged": (("scored", "signals"), _MERGED),
    "scan": (("files", "code_rules"), _SCAN),
    "hooks": (("manifests",), _HOOKS),
    "scanned": (("scan", "hooks"), _SCANNED),
    "pnpm": (("locks",), _PNPM),
    "targets": (("pnpm",), _TARGETS),
    "pkg_targets": (("targets",), _PKG_TARGETS),
    "roots": (("procs",), _ROOTS),
    "climb": (("procs",), _CLIMB),
    "tracked": (("climb", "roots"), _TRACKED),
    "tracked_strict": (("climb", "roots", "procs"), _TRACKED_STRICT),
    "sess": (("v1u",), _SESSIONS),
    "refined": (("merged", "runs"), _REFINED),
    "process_keys": (("v1",), _PROCESS_KEYS),
    "file_keys": (("v1u",), _FILE_KEYS),
}
RECURSIVE = {"climb"}

_ISO = "strftime(captured_at, '%Y-%m-%dT%H:%M:%S.%fZ')"


def _json(*fields: tuple[str, str, bool]) -> str:
    parts = []
    for i, (name, expr, quoted) in enumerate(fields):
        q = '"' if quoted else ""
        parts.append(f"'{'{' if i == 0 else ','}\"{name}\":{q}' || {expr} || '{q}'")
    return " || ".join(parts) + " || '}'"


_WIRE = _json(*[(n, n, True) for n in ("package_name", "container_id", "detonation_id")],
              *[(n, n, False) for n in ("pid", "ppid", "timestamp_ns")],
              *[(n, n, True) for n in ("event_type", "process_name", "filename")], ("captured_at", _ISO, True),
              *[(n, n, False) for n in ("connect_port", "connect_ip", "write_bytes", "write_fd")])
_RAW_VALUE = f"""
CASE WHEN seq % 17 = 0 THEN left(w, 40) ELSE w END"""
_RAW = f"""(SELECT seq, '{{"package_name":"' || package_name || '","container_id":"' || container_id || '","detonation_id":"' || detonation_id
 || '","pid":"' || CASE WHEN seq % 29 = 0 THEN 'abc' ELSE CAST(pid AS VARCHAR) END || '"' || CASE WHEN seq % 19 <> 0 THEN ',"ppid":' || ppid ELSE '' END
 || ',"timestamp_ns":' || timestamp_ns || ',"event_type":"' || event_type || '","process_name":"' || process_name || '","filename":"' || filename
 || '","captured_at":"' || {_ISO} || '"' || CASE WHEN connect_port <> 0 THEN ',"connect_port":' || connect_port ELSE '' END
 || CASE WHEN connect_ip <> 0 THEN ',"connect_ip":' || connect_ip ELSE '' END || ',"write_bytes":' || write_bytes || ',"write_fd":' || write_fd || '}}' AS w FROM v1)"""

CID = """CASE WHEN regexp_matches(line, 'docker-[^.]{12}') THEN left(regexp_extract(line, 'docker-([^.]*)', 1), 12)
 WHEN regexp_matches(line, '/docker/.{12}') THEN regexp_extract(line, '/docker/(.{12})', 1)
 WHEN regexp_matches(line, '/containerd/.{12}') THEN regexp_extract(line, '/containerd/(.{12})', 1) ELSE '' END"""
_RAW_NAME = """(CASE part_key % 5 WHEN 0 THEN '@scope/' WHEN 1 THEN '._-' ELSE '' END || CASE WHEN part_key % 23 = 0 THEN '' ELSE package_name END)"""
_LINES = "(SELECT detonation_id, unnest(l) AS line, CAST(unnest(range(1, len(l)+1)) AS BIGINT) AS line_no, len(l) AS n FROM (SELECT detonation_id, string_split(log, chr(10)) AS l FROM runs WHERE log <> ''))"
_UNFRAMED = "CASE WHEN strlen(line) > 8 AND left(line, 1) = chr(1) THEN substr(line, 9) ELSE line END"
_TARGET_RUNS = "(SELECT package_name, arg_max(success, (started_at, detonation_id)) AS success FROM runs GROUP BY package_name)"
_EXEC_ORDER = "(SELECT *, row_number() OVER (PARTITION BY detonation_id ORDER BY seq) AS position, count(*) OVER (PARTITION BY detonation_id) AS n FROM v1u WHERE event_type='EXECVE')"
_DOCS = f"(SELECT f.*, {RANK} AS severity_rank FROM found f)"

SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "event_type_name": (("v1",), f"SELECT seq, CAST({_case('event_type', {n: c for c, n in packs.EVENT_TYPES.items()}, '99')} AS BIGINT) AS code, event_type FROM v1"),
    "ipv4_decode": (("v1",), f"SELECT seq, connect_ip, {IP} AS ip FROM v1 WHERE event_type='CONNECT'"),
    "exec_basenames": (("v1",), f"SELECT seq, {BASE.format('filename')} AS basename FROM v1 WHERE event_type='EXECVE'"),
    "events_by_type": (("v1",), "SELECT detonation_id, seq, process_name, write_bytes, write_fd FROM v1 WHERE event_type='WRITE'"),
    "unsafe_file_access": (("v1",), f"SELECT detonation_id, seq, filename FROM v1 WHERE event_type='OPENAT' AND NOT {_starts('trim(filename)', packs.SAFE_PREFIXES)}"),
    "suspicious_file_access": (("v1",), f"SELECT detonation_id, seq, process_name, filename FROM v1 WHERE event_type='OPENAT' AND {_contains('filename', packs.SENSITIVE_PATHS)}"),
    "external_connections": (("v1",), f"SELECT detonation_id, seq, {IP} AS ip, connect_port, starts_with({IP}, '104.16.') AS known_cdn FROM v1 WHERE event_type='CONNECT' AND {EXTERNAL}"),
    "nonstandard_processes": (("v1",), f"SELECT detonation_id, seq, trim(process_name) AS process FROM v1 WHERE event_type='EXECVE' AND trim(process_name) NOT IN {_in(packs.EXPECTED_PROCESSES)}"),
    "noise_filter": (("v1",), """SELECT seq, event_type, write_fd, write_bytes, connect_port FROM v1 WHERE event_type <> 'UNKNOWN'
 AND NOT (event_type='WRITE' AND (write_fd <= 2 OR write_bytes = 0)) AND NOT (event_type='CONNECT' AND (seq % 5 = 0 OR seq % 7 = 0))"""),
    "raw_records_decoded": (("v1",), "SELECT seq, pid, ppid, timestamp_ns, event_type, process_name, filename, connect_port, connect_ip, write_bytes, write_fd FROM v1"),
    "container_ids": (("cgroup",), f"SELECT line_no, pid, (contains(line, 'docker') OR contains(line, 'containerd')) AS in_container, {CID} AS container_id FROM cgroup"),
    "sanitized_names": (("registry",), f"""SELECT registry_key, raw, coalesce(nullif(regexp_replace(regexp_replace(raw, '[^a-zA-Z0-9_.-]', '-', 'g'), '^[-_.]+', ''), ''), 'pkg') AS clean
 FROM (SELECT registry_key, {_RAW_NAME} AS raw FROM registry)"""),
    "detonation_ids": (("runs",), "SELECT detonation_id, 'det-' || strftime(started_at, '%Y-%m-%d-%H%M%S') || '-' || package_name AS generated_id FROM runs"),
    "clean_log_lines": (("runs",), f"SELECT detonation_id, line_no, {_UNFRAMED} AS line FROM {_LINES}"),
    "log_line_counts": (("runs",), "SELECT detonation_id, CAST(m % 50 AS BIGINT) AS lines FROM runs"),
    "log_tail": (("runs",), f"SELECT detonation_id, CAST(greatest(n - 30, 0) AS BIGINT) AS truncated, line_no, {_UNFRAMED} AS line FROM {_LINES} WHERE line_no > n - 30"),
    "preview_telemetry": (("v1",), """SELECT seq, CASE WHEN length(event_type) < 6 THEN rpad(event_type, 6, ' ') ELSE event_type END || ' | ' ||
 CASE WHEN length(process_name) < 15 THEN rpad(process_name, 15, ' ') ELSE process_name END || ' → ' || left(filename, 50) AS line FROM v1 ORDER BY seq LIMIT 10"""),
    "scannable_files": (("files",), f"SELECT package, path, length(content) AS chars FROM files WHERE {_SCANNABLE}"),
    "decode_syscalls": (("v1",), f"""SELECT seq, package_name, container_id, detonation_id, pid, ppid, timestamp_ns, event_type, process_name, filename,
 {_ISO} AS captured_at, connect_port, connect_ip, write_bytes, write_fd FROM v1 WHERE seq % 17 <> 0 AND seq % 19 <> 0 AND seq % 29 <> 0"""),
    "rejected_syscalls": (("v1",), f"""SELECT seq, {_RAW_VALUE} AS value, CASE WHEN seq % 17 = 0 THEN 'malformed' WHEN seq % 19 = 0 THEN 'missing field' ELSE 'not a number' END AS reason
 FROM {_RAW} WHERE seq % 17 = 0 OR seq % 19 = 0 OR seq % 29 = 0"""),
    "syscalls_wire": (("v1",), f"SELECT detonation_id AS key, {_WIRE} AS value FROM v1"),
    "exec_rule_hits": (("hits",), "SELECT detonation_id, seq, key AS pattern FROM hits WHERE kind='exec'"),
    "file_rule_hits": (("hits",), "SELECT detonation_id, seq, key AS pattern FROM hits WHERE kind='file'"),
    "unlink_findings": (("hits",), "SELECT detonation_id, key AS filename, min(seq) AS order_key, CAST(15 AS BIGINT) AS points FROM hits WHERE kind='unlink' GROUP BY detonation_id, key"),
    "exec_burst": (("bursts_u",), "SELECT * FROM bursts_u"),
    "connection_findings": (("v1",), f"SELECT DISTINCT detonation_id, {IP} AS ip, connect_port, CAST(20 AS BIGINT) AS points FROM v1 WHERE event_type='CONNECT' AND {EXTERNAL} AND NOT starts_with({IP}, '104.16.')"),
    "event_type_counts": (("scored",), "SELECT detonation_id, events_analyzed, execve_count, openat_count, connect_count, write_count, unlink_count FROM scored"),
    "findings": (("found",), "SELECT detonation_id, kind, key, points, severity, category, description, evidence, mitre_id, mitre_name FROM found"),
    "threat_scores": (("scored",), "SELECT detonation_id, threat_score FROM scored"),
    "verdicts": (("scored",), "SELECT * FROM scored"),
    "user_verdicts": (("scored_u",), "SELECT * FROM scored_u"),
    "risk_bands": (("scored",), "SELECT detonation_id, threat_score, risk_level, recommendation FROM scored"),
    "mitre_summary": (("found", "scored"), "SELECT mitre_id, mitre_name, count(*) AS findings, CAST(sum(points) AS BIGINT) AS points, count(DISTINCT package_name) AS packages FROM found JOIN scored USING (detonation_id) GROUP BY ALL"),
    "category_summary": (("found", "scored"), "SELECT category, count(*) AS findings, CAST(sum(points) AS BIGINT) AS points, count(DISTINCT package_name) AS packages FROM found JOIN scored USING (detonation_id) GROUP BY ALL"),
    "ordered_findings": (("found_u",), f"SELECT detonation_id, CAST({RANK} AS BIGINT) AS severity_rank, CAST(phase AS BIGINT) AS phase, order_key, ordinal, kind, key, description, evidence FROM found_u"),
    "package_age": (("registry",), f"SELECT registry_key, {AGE} AS age_days, CASE WHEN {AGE} < 7 THEN 'HIGH' WHEN {AGE} < 30 THEN 'MEDIUM' END AS severity FROM registry WHERE status='ok' AND published_us IS NOT NULL"),
    "low_downloads": (("registry",), "SELECT registry_key, weekly_downloads, CASE WHEN weekly_downloads < 100 THEN 'HIGH' ELSE 'LOW' END AS severity FROM registry WHERE status='ok' AND weekly_downloads < 1000"),
    "single_maintainer": (("registry",), "SELECT registry_key, CASE n_maintainers WHEN 0 THEN 'unknown' ELSE 'm0' END AS maintainer, 'LOW' AS severity FROM registry WHERE status='ok' AND n_maintainers <= 1"),
    "typosquat_candidates": (("near", "registry"), "SELECT registry_key, package_name, target, distance FROM near JOIN registry USING (registry_key)"),
    "typosquat_from_table": (("near_table", "registry"), "SELECT registry_key, package_name, target, distance FROM near_table JOIN registry USING (registry_key)"),
    "registry_summary_from_table": (("near_table", "registry"), "SELECT registry_key, status='ok' AS available, target AS typosquat_target FROM registry LEFT JOIN near_table USING (registry_key)"),
    "metadata_findings_from_table": (("signals_table",), "SELECT registry_key, CAST(ordinal AS BIGINT) AS ordinal, severity, evidence FROM signals_table"),
    "rejected_lockfiles": (("locks",), """SELECT DISTINCT project, dialect, CASE dialect WHEN 'pnpm' THEN 'not in block style' ELSE 'not readable' END AS problem
 FROM locks, unnest(['npm', 'manifest', 'pnpm']) AS u(dialect) WHERE CAST(project[6:] AS BIGINT) % 2 = 0"""),
    "not_in_registry": (("registry",), "SELECT registry_key, package_name, 'MEDIUM' AS severity FROM registry WHERE status='error'"),
    "registry_summary": (("registry", "near"), f"""SELECT registry_key, package_name, status='ok' AS available, CASE WHEN status='ok' THEN latest_version END AS latest_version,
 CASE WHEN status='ok' THEN version_count END AS total_versions, CASE WHEN status='ok' THEN least(n_maintainers, 3) END AS maintainers,
 CASE WHEN status='ok' THEN CASE n_maintainers WHEN 0 THEN '' WHEN 1 THEN 'm0' WHEN 2 THEN 'm0,m1' ELSE 'm0,m1,m2' END END AS maintainer_names,
 CASE WHEN status='ok' THEN {AGE} END AS age_days, CASE WHEN status='ok' THEN weekly_downloads END AS weekly_downloads, target AS typosquat_target
 FROM registry LEFT JOIN near USING (registry_key)"""),
    "metadata_findings": (("signals",), "SELECT registry_key, CAST(ordinal AS BIGINT) AS ordinal, severity, description, evidence FROM signals"),
    "merged_verdicts": (("merged",), "SELECT detonation_id, package_name, threat_score, risk_level, metadata_findings, finding_count FROM merged"),
    "run_metadata_findings": (("scored", "signals"), "SELECT detonation_id, CAST(ordinal AS BIGINT) AS ordinal, severity, evidence FROM scored JOIN signals ON registry_key = package_name"),
    "lifecycle_hooks": (("hooks",), """SELECT package, hook, 'HIGH' AS severity, 'scripts.' || hook || ' = "' || script || '"' AS evidence, 'T1204.002' AS mitre_id FROM hooks"""),
    "scan_patterns": (("scan",), "SELECT package, path, CAST(rule_no AS BIGINT) AS rule_no, line_no, severity, category, description, evidence, mitre_id, mitre_name FROM scan"),
    "scan_findings": (("scanned",), "SELECT package, path, CAST(rule_no AS BIGINT) AS rule_no, CAST(severity_rank AS BIGINT) AS severity_rank, severity, evidence FROM scanned"),
    "static_score": (("scanned",), "SELECT package, count(*) AS findings, CAST(least(sum(CASE severity WHEN 'CRITICAL' THEN 25 WHEN 'HIGH' THEN 15 WHEN 'MEDIUM' THEN 5 ELSE 2 END), 100) AS BIGINT) AS static_score FROM scanned GROUP BY package"),
    "scan_custom_pack": (("custom_rules",), """SELECT text_id, CAST(ordinal AS BIGINT) AS rule_no, min(line_no) AS line_no FROM
 (SELECT text_id, unnest(l) AS line, unnest(range(1, len(l)+1)) AS line_no FROM (SELECT text_id, regexp_split_to_array(content, '\\r\\n|\\r|\\n') AS l FROM
  (SELECT 'd' || doc_id AS text_id, text AS content FROM documents UNION ALL SELECT 'p' || page_id, html FROM pages)))
 JOIN custom_rules ON regexp_matches(line, pattern) GROUP BY text_id, ordinal"""),
    "npm_lock_targets": (("locks",), """SELECT project, lock_key, coalesce(own, regexp_replace(lock_key, '^.*node_modules/', '')) AS name, version FROM
 (SELECT project, npm_key AS lock_key, max(version) AS version, max(own_name) AS own FROM locks GROUP BY project, npm_key) WHERE lock_key <> ''"""),
    "npm_v1_targets": (("locks",), "SELECT project, name, max(version) AS version FROM locks GROUP BY project, name"),
    "pnpm_targets": (("pnpm",), "SELECT * FROM pnpm"),
    "manifest_targets": (("locks",), "SELECT project, name, coalesce(max(version) FILTER (WHERE is_dev), max(version)) AS version FROM locks GROUP BY project, name"),
    "distinct_targets": (("targets",), "SELECT * FROM targets"),
    "limited_targets": (("targets",), f"""SELECT project, name, version, total FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY name) AS rn,
 count(*) OVER (PARTITION BY project) AS total FROM targets) WHERE rn <= 3"""),
    "package_specs": (("targets",), "SELECT project, name || '@' || version AS spec, name AS spec_name, version AS spec_version FROM targets"),
    "batch_outcomes": (("pkg_targets", "runs"), f"""SELECT project, count(*) AS targets, count(*) FILTER (WHERE success) AS succeeded, count(*) FILTER (WHERE NOT success) AS failed,
 count(*) FILTER (WHERE success IS NULL) AS not_run FROM pkg_targets LEFT JOIN {_TARGET_RUNS} USING (package_name) GROUP BY project"""),
    "dependency_risk": (("pkg_targets", "scored"), """SELECT project, count(*) AS targets, count(score) AS assessed, max(score) AS worst_score, count(*) FILTER (WHERE score >= 60) AS malicious,
 count(*) FILTER (WHERE score BETWEEN 25 AND 59) AS suspicious, count(*) FILTER (WHERE score < 25) AS safe
 FROM pkg_targets LEFT JOIN (SELECT package_name, max(threat_score) AS score FROM scored GROUP BY package_name) USING (package_name) GROUP BY project"""),
    "marker_roots": (("roots",), "SELECT pid, epoch_us(since) AS since FROM roots"),
    "descendant_pids": (("tracked",), "SELECT pid FROM tracked"),
    "descendant_pids_strict": (("tracked_strict",), "SELECT pid, epoch_us(since) AS since FROM tracked_strict"),
    "scoped_events": (("tracked", "procs"), "SELECT pid, host, exec_file FROM procs WHERE pid IN (SELECT pid FROM tracked)"),
    "tracked_pid_count": (("tracked", "procs"), "SELECT host, count(*) AS tracked_pids FROM procs WHERE pid IN (SELECT pid FROM tracked) GROUP BY host"),
    "attributed_events": (("v1", "cgroup"), f"""SELECT seq, v1.pid, coalesce(c.cid, '') AS container_id FROM v1 LEFT JOIN
 (SELECT pid, {CID} AS cid FROM (SELECT pid, arg_min(line, line_no) AS line FROM cgroup WHERE contains(line, 'docker') OR contains(line, 'containerd') GROUP BY pid)) c ON c.pid = v1.pid"""),
    "namespace_siblings": (("procs",), f"""SELECT p.host, p.pid, p.cmdline, p.mnt_ns FROM procs p JOIN
 (SELECT host, arg_min(mnt_ns, pid) AS mnt_ns FROM procs WHERE contains(cmdline, '{packs.MARKER_FILE}') GROUP BY host) USING (host, mnt_ns)"""),
    "triage_route": (("merged",), "SELECT detonation_id, threat_score, CASE WHEN threat_score <= 10 THEN 'clearly safe' WHEN threat_score <= 59 THEN 'llm' ELSE 'clearly malicious' END AS route, threat_score >= 60 AS attack_chain FROM merged"),
    "process_digest": (("process_keys",), """SELECT detonation_id, position, '  - ' || process_name || ' executed: ' || filename || ' (PID=' || pid || ')' AS line FROM
 (SELECT *, row_number() OVER (PARTITION BY detonation_id ORDER BY seq) AS position FROM process_keys) WHERE position <= 30"""),
    "file_digest": (("file_keys",), """SELECT detonation_id, position, unique_files, '  - ' || process_name || ' accessed: ' || filename AS line FROM
 (SELECT *, row_number() OVER (PARTITION BY detonation_id ORDER BY seq) AS position, count(*) OVER (PARTITION BY detonation_id) AS unique_files FROM file_keys) WHERE position <= 50"""),
    "connection_digest": (("v1",), f"SELECT detonation_id, seq, '  - ' || process_name || ' → ' || {IP} || ':' || connect_port AS line FROM v1 WHERE event_type='CONNECT'"),
    "deletion_digest": (("v1",), "SELECT detonation_id, seq, '  - ' || process_name || ' deleted: ' || filename AS line FROM v1 WHERE event_type='UNLINK' AND filename <> ''"),
    "finding_digest": (("found", "scored"), f"""SELECT detonation_id, CAST({RANK} AS BIGINT) AS severity_rank, CAST(phase AS BIGINT) AS phase, '  - [' || severity || '] [' || mitre_id || '] ' || description || ': ' || evidence AS line FROM found
 UNION ALL SELECT detonation_id, 0, 0, '  (no findings from rule engine)' FROM scored WHERE finding_count = 0"""),
    "parsed_responses": (("runs",), f"""SELECT detonation_id, {_GOOD} AS parsed, CAST(CASE m % 7 WHEN 1 THEN 42 WHEN 2 THEN 42 WHEN 4 THEN 150 WHEN 5 THEN -5 WHEN 6 THEN 20 END AS BIGINT) AS threat_score,
 CASE m % 7 WHEN 1 THEN 'suspicious' WHEN 2 THEN 'suspicious' WHEN 4 THEN 'MALICIOUS' WHEN 5 THEN 'weird' WHEN 6 THEN 'SAFE' END AS risk_level,
 CASE WHEN {_GOOD} THEN 'check it' END AS recommendation, CAST(CASE WHEN {_GOOD} THEN 2 ELSE -1 END AS BIGINT) AS findings FROM runs WHERE m % 7 <> 0"""),
    "merged_responses": (("refined",), "SELECT detonation_id, CAST(threat_score AS BIGINT) AS threat_score, risk_level, recommendation, analysis_method, events_analyzed, CAST(finding_count AS BIGINT) AS finding_count FROM refined"),
    "merged_chains": (("refined",), """SELECT detonation_id, CAST(threat_score AS BIGINT) AS threat_score,
 CASE WHEN threat_score >= 60 AND m % 3 > 0 THEN 'hybrid (rules + LLM attack chain)' ELSE analysis_method END AS analysis_method,
 CASE WHEN threat_score >= 60 AND m % 3 > 0 THEN CASE m % 3 WHEN 1 THEN 'steals keys' ELSE 'only words' END ELSE '' END AS executive_summary,
 CAST(CASE WHEN threat_score >= 60 AND m % 3 = 1 THEN 3 ELSE 0 END AS BIGINT) AS stages FROM refined"""),
    "top_processes": (("v1u",), f"SELECT detonation_id, position, pid, process_name, filename, greatest(n - 15, 0) AS more FROM {_EXEC_ORDER} WHERE position <= 15"),
    "report_index": (("scored", "runs"), "SELECT replace(detonation_id, '/', '_') AS report_id, s.package_name, threat_score, risk_level, epoch_us(ended_at) AS analyzed_at, events_analyzed, finding_count AS findings FROM scored s JOIN runs USING (detonation_id)"),
    "report_findings": (("found",), f"""SELECT detonation_id AS report_id, row_number() OVER (PARTITION BY detonation_id ORDER BY severity_rank, phase, order_key, ordinal) - 1 AS position, severity, evidence FROM {_DOCS}"""),
    "report_by_id": (("scored",), "SELECT detonation_id AS report_id, package_name, threat_score, risk_level FROM scored WHERE detonation_id IN (SELECT 'det-' || user_id || '-2' FROM events)"),
    "run_forensics": (("v1", "runs"), f"""SELECT detonation_id, r.package_name, left(r.container_id, 12) AS container_id, CAST(round((epoch_us(ended_at) - epoch_us(started_at)) / 1000.0) AS BIGINT) AS duration_ms,
 CAST(m % 50 AS BIGINT) AS log_lines, c.* EXCLUDE (detonation_id), greatest(execve_count - 15, 0) AS more_processes, success FROM runs r JOIN
 (SELECT detonation_id, count(*) AS events_analyzed, count(*) FILTER (WHERE event_type='EXECVE') AS execve_count, count(*) FILTER (WHERE event_type='OPENAT') AS openat_count,
  count(*) FILTER (WHERE event_type='CONNECT') AS connect_count, count(*) FILTER (WHERE event_type='WRITE') AS write_count, count(*) FILTER (WHERE event_type='UNLINK') AS unlink_count,
  count(*) FILTER (WHERE event_type='OPENAT' AND {_contains('filename', packs.SENSITIVE_PATHS)}) AS suspicious_files,
  count(*) FILTER (WHERE event_type='UNLINK' AND filename <> '') AS deletions_listed FROM v1 GROUP BY detonation_id) c USING (detonation_id)"""),
    "session_list": (("sess",), "SELECT detonation_id, epoch_us(session_start) AS session_start, epoch_us(session_last) AS session_last, events, package_name FROM sess"),
    "windowed_events": (("v1", "runs"), "SELECT detonation_id, seq, event_type FROM v1 JOIN runs USING (detonation_id) WHERE captured_at <= least(started_at + INTERVAL 2 DAY, ended_at)"),
    "delivery_audit": (("v1",), "SELECT detonation_id, count(*) AS captured, count(*) FILTER (WHERE seq % 11 <> 3) AS streamed, count(*) FILTER (WHERE seq % 11 = 3) AS failed FROM v1 GROUP BY detonation_id"),
    "undelivered_events": (("v1",), "SELECT detonation_id, seq FROM v1 WHERE seq % 11 = 3"),
}


def _session_runs() -> tuple[str, str]:
    """Views for ``session_verdicts``: events keyed by session, scored as runs."""
    keyed = """SELECT v.* EXCLUDE (detonation_id), v.detonation_id || '@' || epoch_us(session_start) AS detonation_id
 FROM v1u v JOIN sess s ON s.detonation_id = v.detonation_id AND captured_at BETWEEN session_start AND session_last"""
    return keyed, """SELECT split_part(detonation_id, '@', 1) AS detonation_id, CAST(split_part(detonation_id, '@', 2) AS BIGINT) AS session_start,
 threat_score, events_analyzed, finding_count FROM scored_s"""


VIEWS["host_procs"] = (("procs",), """
SELECT host, pid // 2 AS pid, CASE WHEN pid // 2 > 0 THEN (pid // 2 - 1) // 3 END AS ppid, fork_ts, exec_file FROM procs""")
VIEWS["reused_procs"] = (("host_procs",), f"SELECT host, pid % {a.MAX_PID} AS pid, ppid % {a.MAX_PID} AS ppid, fork_ts, exec_file FROM host_procs")
for _view in ("host", "reused"):
    VIEWS[f"{_view}_roots"] = ((f"{_view}_procs",), f"""
SELECT host, ppid AS pid, min(fork_ts) AS since FROM {_view}_procs WHERE exec_file = '{packs.MARKER_FILE}' AND ppid IS NOT NULL GROUP BY host, ppid""")
    # a breadth-first walk over ids; a row per id and time of a fork
    VIEWS[f"{_view}_walk"] = ((f"{_view}_procs", f"{_view}_roots"), f"""
SELECT host, pid, since FROM {_view}_roots
UNION SELECT p.host, p.pid, p.fork_ts FROM {_view}_walk w JOIN {_view}_procs p ON p.host = w.host AND p.ppid = w.pid{' AND p.fork_ts >= w.since' if _view == 'reused' else ''}""")
    RECURSIVE.add(f"{_view}_walk")
    SQL[f"descendant_pids_{'by_host' if _view == 'host' else 'reused'}"] = (
        (f"{_view}_walk",), f"SELECT host, pid, epoch_us(min(since)) AS since FROM {_view}_walk GROUP BY host, pid")

_LAST = """SELECT split_part(detonation_id, '@', 1) AS run, CAST(split_part(detonation_id, '@', 2) AS BIGINT) AS session_start, * EXCLUDE (session_start) FROM
 (SELECT *, 0 AS session_start FROM scored_s) QUALIFY row_number() OVER (PARTITION BY split_part(detonation_id, '@', 1) ORDER BY CAST(split_part(detonation_id, '@', 2) AS BIGINT) DESC) = 1"""
SQL["streamed_sessions"] = SQL["session_list"]
SQL["active_sessions"] = (("sess", "v1u"), SQL["session_list"][1] + """
 WHERE session_last + INTERVAL 6 HOUR >= (SELECT max(captured_at) FROM v1u) - INTERVAL 1 DAY""")


def _parts_of_reports(size: int) -> str:
    return f"""SELECT s.detonation_id AS report_id, CAST(coalesce(part_no, 0) AS BIGINT) AS part_no, coalesce(findings, 0) AS findings,
 first_evidence, last_evidence, last_severity, threat_score, events_analyzed FROM scored s LEFT JOIN
 (SELECT detonation_id, rn // {size} AS part_no, count(*) AS findings, arg_min(evidence, rn) AS first_evidence, arg_max(evidence, rn) AS last_evidence, arg_max(severity, rn) AS last_severity
  FROM (SELECT *, row_number() OVER (PARTITION BY detonation_id ORDER BY severity_rank, phase, order_key, ordinal, kind, key) - 1 AS rn FROM {_DOCS}) GROUP BY ALL) p USING (detonation_id)"""


SQL["report_parts"] = (("scored", "found"), _parts_of_reports(2))
SQL["document_index"] = SQL["report_index"]

VIEWS["file_keys_1"] = (("v1",), _FILE_KEYS.replace("v1u", "v1"))
VIEWS["prompt_lines"] = (("found", "scored", "process_keys", "file_keys_1", "v1"), f"""
SELECT detonation_id, 0 AS section, {RANK} AS rank, phase, order_key AS key, ordinal, '  - [' || severity || '] [' || mitre_id || '] ' || description || ': ' || evidence AS line FROM found
UNION ALL SELECT detonation_id, 0, 0, 0, 0, 0, '  (no findings from rule engine)' FROM scored WHERE finding_count = 0
UNION ALL SELECT detonation_id, 1, 0, 0, seq, 0, '  - ' || process_name || ' executed: ' || filename || ' (PID=' || pid || ')' FROM process_keys
 QUALIFY row_number() OVER (PARTITION BY detonation_id ORDER BY seq) <= 30
UNION ALL SELECT detonation_id, 2, 0, 0, seq, 0, '  - ' || process_name || ' accessed: ' || filename FROM file_keys_1
 QUALIFY row_number() OVER (PARTITION BY detonation_id ORDER BY seq) <= 50
UNION ALL SELECT detonation_id, 3, 0, 0, seq, 0, '  - ' || process_name || ' → ' || {IP} || ':' || connect_port FROM v1 WHERE event_type='CONNECT'
UNION ALL SELECT detonation_id, 4, 0, 0, seq, 0, '  - ' || process_name || ' deleted: ' || filename FROM v1 WHERE event_type='UNLINK' AND filename <> ''""")


def _prompts(where: str, head: str, titles: tuple[str, ...], none: tuple[str, ...], tail: str, size: int) -> str:
    sections = ", ".join(
        f"concat_ws(chr(10), {title}, CASE WHEN total{k} = 0 THEN {t(none[k])} ELSE text{k} END)" for k, title in enumerate(titles))
    totals = ", ".join(f"count(*) FILTER (WHERE section = {k}) OVER (PARTITION BY detonation_id) AS total{k}" for k in range(5))
    texts = ", ".join(f"string_agg(line, chr(10) ORDER BY rn) FILTER (WHERE section = {k}) AS text{k}, any_value(total{k}) AS total{k}" for k in range(5))
    return f"""SELECT detonation_id, part_no, concat_ws(chr(10), {head}, 'Part ' || (part_no + 1) || ' of ' || ((n + {size} - 1) // {size}), {sections}, {tail}) AS prompt
FROM (SELECT * FROM scored WHERE {where}) s JOIN
 (SELECT detonation_id, rn // {size} AS part_no, any_value(n) AS n, {texts} FROM
  (SELECT *, row_number() OVER (PARTITION BY detonation_id ORDER BY section, rank, phase, key, ordinal, line) - 1 AS rn,
   count(*) OVER (PARTITION BY detonation_id) AS n, {totals} FROM prompt_lines) GROUP BY detonation_id, rn // {size}) p USING (detonation_id)
LEFT JOIN (SELECT detonation_id, count(*) AS files FROM file_keys_1 GROUP BY detonation_id) f USING (detonation_id)"""


_COUNTED = """'Judge an npm package by what its installation did in a sandbox.' || chr(10) || 'Package: ' || package_name || chr(10) || 'Run: ' || detonation_id
 || chr(10) || 'Events: ' || events_analyzed || ' (EXECVE ' || execve_count || ', OPENAT ' || openat_count || ', CONNECT ' || connect_count || ', WRITE ' || write_count
 || ', UNLINK ' || unlink_count || ')' || chr(10) || 'Rule score: ' || threat_score || '/100'"""
_TITLES = ("'# Findings of the rules'", "'# Processes started (' || execve_count || ' in total)'",
           "'# Files opened outside the install paths (' || coalesce(files, 0) || ' unique)'", "'# Connections'", "'# Deleted files'")
_NONE = ("  (no findings from rule engine)", "  (none beyond npm and node)", "  (none beyond the install paths)", "  (none)", "  (none)")
_CHAIN_TITLES = ("'# Findings of the rules'", "'# Processes started'", "'# Files opened outside the install paths'", "'# Connections'", "'# Deleted files'")
_PROMPT_VIEWS = ("scored", "prompt_lines", "file_keys_1")
for _name, _size in (("analysis_prompts", 2000), ("analysis_prompt_parts", 7)):
    SQL[_name] = (_PROMPT_VIEWS, _prompts("threat_score BETWEEN 11 AND 59", _COUNTED, _TITLES, _NONE, t(narrative.ANSWER_SHAPE), _size))
SQL["attack_chain_prompts"] = (_PROMPT_VIEWS, _prompts(
    "threat_score >= 60", "'Reconstruct the attack carried out by a malicious npm package.' || chr(10) || 'Package: ' || package_name || chr(10) || 'Threat score: ' || threat_score || '/100'",
    _CHAIN_TITLES, (_NONE[0], *["  (none)"] * 4), "'# Writes: ' || write_count || chr(10) || " + t(narrative.CHAIN_SHAPE), 2000))

VIEWS["v1s"] = (("v1u", "sess"), _session_runs()[0])
VIEWS["hits_s"] = (("v1s", "exec_rules", "file_rules"), _hits("v1s"))
VIEWS["bursts_s"] = (("v1s",), _bursts("v1s"))
VIEWS["found_s"] = (("hits_s", "bursts_s"), _found("hits_s", "bursts_s"))
VIEWS["scored_s"] = (("v1s", "found_s"), _verdicts("v1s", "found_s"))
SQL["session_verdicts"] = (("scored_s",), _session_runs()[1])
SQL["streamed_reports"] = (("scored_s",), f"""SELECT run AS detonation_id, session_start, threat_score, events_analyzed, finding_count FROM ({_LAST})""")


def _with(names: tuple[str, ...]) -> list[str]:
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in ordered:
            return
        for needed in VIEWS[name][0]:
            add(needed)
        ordered.append(name)

    for n in names:
        add(n)
    return ordered


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, (views, body) in SQL.items():
        ctes = _with(views)
        head = ",\n".join(f"{v} AS ({VIEWS[v][1].strip()})" for v in ctes)
        keyword = "WITH RECURSIVE" if RECURSIVE & set(ctes) else "WITH"
        out[name] = f"{keyword} {head}\n{body}" if ctes else body
    return out
