"""The adapter views of ``adapters`` as SQL, for the comparison in another engine."""

from __future__ import annotations

from ..functions import packs
from . import adapters as a


def text(value: str) -> str:
    """SQL string literal; control characters become chr() calls."""
    out, plain = [], ""
    for ch in value:
        if ord(ch) < 32:
            out.append("'" + plain + "'")
            out.append(f"chr({ord(ch)})")
            plain = ""
        else:
            plain += ch.replace("'", "''")
    if not out:
        return "'" + plain + "'"
    out.append("'" + plain + "'")
    return "(" + " || ".join(out) + ")"


def array(values) -> str:
    return "[" + ", ".join(text(v) if isinstance(v, str) else str(v) for v in values) + "]"


def pick(values, index: str) -> str:
    return f"({array(values)})[({index})+1]"


def _syscalls(run: str) -> str:
    return f"""
SELECT event_id AS seq, ts AS captured_at, event_id*1000 AS timestamp_ns,
 'pkg-' || (user_id % 60) AS package_name, {run} AS detonation_id, md5({run}) AS container_id,
 1000 + event_id % 200 AS pid, 1000 + (event_id % 200) // 3 AS ppid,
 CASE et WHEN 'view' THEN 'EXECVE' WHEN 'click' THEN 'OPENAT' WHEN 'purchase' THEN 'WRITE' WHEN 'signup' THEN 'CONNECT'
  ELSE CASE h % 10 WHEN 0 THEN 'UNLINK' WHEN 1 THEN 'UNKNOWN' ELSE 'OPENAT' END END AS event_type,
 CASE WHEN et='view' THEN {pick(a.EXEC_PROCESSES, 'h % 16')} ELSE {pick(a.OTHER_PROCESSES, 'h % 6')} END AS process_name,
 CASE WHEN et='view' THEN {pick(a.EXEC_FILES, 'h % 16')} WHEN et IN ('click','error') THEN {pick(a.OPEN_FILES, 'h % 24')}
  ELSE '' END AS filename,
 CAST(CASE WHEN et='signup' THEN {pick(a.CONNECT_IPS, 'h % 8')} ELSE 0 END AS BIGINT) AS connect_ip,
 CAST(CASE WHEN et='signup' THEN {pick(a.CONNECT_PORTS, 'h % 4')} ELSE 0 END AS BIGINT) AS connect_port,
 CAST(CASE WHEN et='purchase' THEN floor(value*10) ELSE 0 END AS BIGINT) AS write_bytes,
 CAST(CASE WHEN et='purchase' THEN event_id % 6 ELSE 0 END AS BIGINT) AS write_fd
FROM ev"""


_EV = """
SELECT event_id, ts, user_id, event_type AS et, value,
 event_id*7 + CAST(regexp_extract(props, '(-?[0-9]+)', 1) AS BIGINT) AS h FROM events"""

_REGISTRY = f"""
SELECT k AS part_key, 'pkg-' || k AS registry_key,
 CASE s % 6 WHEN 0 THEN b WHEN 1 THEN b[:-2] WHEN 2 THEN b || right(b, 1) WHEN 3 THEN 'x-' || b
  WHEN 4 THEN b || '-utils' ELSE upper(b) END AS package_name,
 CASE WHEN k % 29 = 0 AND k > 0 THEN 'error' WHEN k % 31 = 0 AND k > 0 THEN 'missing' ELSE 'ok' END AS status,
 s || '.0.0' AS latest_version, s AS version_count,
 CASE WHEN k % 17 <> 0 THEN epoch_us(TIMESTAMP '{a.AS_OF}') - (k % 60)*86400000000 - s*3600000000 END AS published_us,
 CASE WHEN k % 7 <> 0 THEN k*37 % 5000 END AS weekly_downloads,
 k % 4 AS n_maintainers
FROM (SELECT p_partkey AS k, CAST(p_size AS BIGINT) AS s, {pick(packs.POPULAR_PACKAGES, 'p_partkey % 45')} AS b FROM part)"""

_LOCK = """
SELECT 'proj-' || (k // 100) AS project, k AS part_key, name, version,
 CASE WHEN k % 100 = 0 THEN '' ELSE CASE s % 4 WHEN 0 THEN 'node_modules/' || name
  WHEN 1 THEN 'node_modules/a/node_modules/@s/' || name WHEN 2 THEN 'packages/' || name ELSE name END END AS npm_key,
 CASE WHEN k % 2 = 0 THEN '/' ELSE '' END || CASE WHEN k % 3 = 0 THEN '@s/' ELSE '' END || name || '@' || version
  || CASE WHEN k % 5 = 0 THEN '(peer@1.0.0)' ELSE '' END AS pnpm_key,
 CASE WHEN k % 11 = 0 THEN '@own/' || name END AS own_name, k % 3 = 0 AS is_dev
FROM (SELECT p_partkey AS k, CAST(p_size AS BIGINT) AS s, 'lib-' || (p_partkey*7 % 60) AS name,
  p_size || '.' || (p_partkey % 10) || '.0' AS version FROM part)"""

_PROCESSES = f"""
SELECT 'h' || (event_id % 2) AS host, event_id AS pid, CASE WHEN event_id > 0 THEN (event_id-1)//3 END AS ppid,
 ts AS fork_ts, x AS exec_file, x || ' --id ' || event_id AS cmdline, 'mnt-' || (event_id % 50) AS mnt_ns
FROM (SELECT *, CASE WHEN event_id % 500 = 100 THEN '{packs.MARKER_FILE}' ELSE {pick(a.EXEC_FILES, 'h % 16')} END AS x FROM ev)"""

_FILES = f"""
SELECT source || '-' || (doc_id // 100) AS package,
 CASE WHEN doc_id % 13 = 0 THEN 'node_modules/x/' ELSE '' END || 'src/f' || doc_id ||
 CASE lang {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in a.SUFFIX_BY_LANG.items())} ELSE '.txt' END AS path,
 text || chr(10) || {pick(a.SNIPPETS, '(doc_id + doc_id//20) % 20')} AS content
FROM documents"""

_MANIFESTS = f"""
SELECT source || '-' || block AS package, 'package.json' AS path,
 {pick(a.MANIFESTS, "(CAST(regexp_extract(source, '([0-9]+)', 1) AS BIGINT) + block) % 4")} AS content
FROM (SELECT DISTINCT source, doc_id // 100 AS block FROM documents)"""

_RUNS = """
SELECT *, CASE WHEN m % 50 = 0 THEN '' ELSE (SELECT string_agg(CASE WHEN i % 3 = 0 THEN chr(1) || 'AAAAAAA' ELSE '' END || 'line' || i,
  chr(10) ORDER BY i) FROM range(1, m % 50 + 1) AS t(i)) END AS log, m % 9 <> 0 AS success
FROM (SELECT detonation_id, max(package_name) AS package_name, max(container_id) AS container_id,
 min(captured_at) AS started_at, max(captured_at) AS ended_at, min(seq) AS m FROM v1 GROUP BY detonation_id)"""

_CGROUP = """
SELECT pid, k AS line_no, CASE WHEN pid % 10 = 9 THEN '0::/user.slice' ELSE CASE (k + k//250) % 5
 WHEN 0 THEN '0::/system.slice/docker-' || d || d || '.scope' WHEN 1 THEN '0::/docker/' || d || d
 WHEN 2 THEN '0::/containerd/' || d || d WHEN 3 THEN '0::/user.slice' ELSE '0::/docker/short' END END AS line
FROM (SELECT o_orderkey AS k, 1000 + o_orderkey % 250 AS pid, md5(CAST(1000 + o_orderkey % 250 AS VARCHAR)) AS d FROM orders)"""

VIEWS = {
    "ev": ((), _EV),
    "v1": (("ev",), _syscalls("('det-' || user_id || '-' || ((day(ts)-1)//6))")),
    "v1u": (("ev",), _syscalls("('det-' || user_id)")),
    "files": ((), _FILES),
    "manifests": ((), _MANIFESTS),
    "registry": ((), _REGISTRY),
    "locks": ((), _LOCK),
    "procs": (("ev",), _PROCESSES),
    "runs": (("v1",), _RUNS),
    "cgroup": ((), _CGROUP),
}
