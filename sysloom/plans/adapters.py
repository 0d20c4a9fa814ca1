"""Adapter views: the telemetry shapes derived from the test tables.

Every function reads a whole table.  The same rules are written as SQL in
``adapter_sql``; ``FIXTURES.md`` describes them.  Palettes are fixture data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import packs
from ..functions.columns import sql_text

EXEC_PROCESSES = ("sh", "npm", "node", "mkdir", "cp", "node", "sh", "npm", "sh", "whoami", "node", "curl",
                  "sh", "node", "npm", "node")
OTHER_PROCESSES = ("node", "npm", "npm install x", "libuv-worker", "sh", " node ")
EXEC_FILES = ("/bin/sh", "/usr/local/bin/npm", "/usr/local/bin/node", "/bin/mkdir", "/bin/cp",
              "/usr/local/bin/node", "/bin/sh", "npm", "/bin/uname", "/usr/bin/whoami", "/usr/bin/python3",
              "/usr/bin/curl", "/bin/chmod", "/usr/bin/id/", "/usr/local/bin/npm", "/usr/bin/nc")
OPEN_FILES = ("/app/node_modules/a/index.js", "/usr/local/lib/node_modules/npm/x.js", "/root/.npm/_cacache/1",
              "/lib/ld-musl-x86_64.so.1", "/etc/hosts", "/root/.npmrc", "/app/package.json", "/proc/self/maps",
              "/tmp/npm-1/a", "/etc/passwd", "/app/node_modules/b/.npmrc", "/etc/ssl/cert.pem",
              "/usr/local/bin/node", "/app/src/a.js", "/root/.gitconfig", "/app/b.js", "/home/u/.npmrc",
              "/root/.ssh/id_rsa", "/app/c.js", "/app/d.js", "/etc/shadow", "", "/app/e.js", "/app/f.js")
CONNECT_IPS = (16777343, 0, 4164, 117641320, 117641320, 16777343, 0, 134744072)
CONNECT_PORTS = (443, 80, 443, 8080)
SNIPPETS = (
    "let a = eval (x)", 'Buffer.from(p, "base64")', 'var s="' + r"\x41" * 12 + '"', "atob(z)", 'new Function("a")',
    'require("child_process")', 'execSync("ls")', 'cp.exec("ls")', 'spawn("sh")',
    'get("http://cdn.evil.com/x")', 'get("http://10.1.2.3/x")', 'open("/etc/shadow")', "cat ~/.ssh/id_rsa",
    "echo x >> /etc/crontab", 'read(".npmrc")', "fs.writeFileSync(f)",
    "const ok = 1", "medieval(x)", "function (a) {}", "https://evil",
)
MANIFESTS = (
    '{"name": "p", "scripts": {"postinstall": "node p.js", "test": "jest"}}',
    '{"name": "p", "scripts": {"test": "jest"}}',
    '{"name": "p", "scripts": {"install": "make", "preinstall": "sh pre.sh"}}',
    '{"name": "p", "scripts": {"install": "ma',
)
SUFFIX_BY_LANG = {"en": ".js", "fr": ".ts", "de": ".py", "es": ".md"}
AS_OF = "2024-01-31 00:00:00"

CUSTOM_RULES = (
    packs.CodeRule(r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "MEDIUM", "network", "T1071.001", "IPv4 literal"),
    packs.CodeRule(r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z]+", "LOW", "credential_theft", "T1552.001", "E-mail address", "@"),
    packs.CodeRule(r"<script", "HIGH", "suspicious_activity", "T1059", "Script element", "<script"),
)


MAX_PID = 1500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _array_sql(values) -> str:
    return "array(" + ", ".join(sql_text(v) if isinstance(v, str) else str(v) for v in values) + ")"


def _pick_sql(values, index: str) -> str:
    return f"get({_array_sql(values)}, CAST({index} AS INT))"


def _pick(values, index: Column) -> Column:
    return F.get(F.expr(_array_sql(values)), index.cast("int"))


def _floor_div(x: Column, n: int) -> Column:
    return F.floor(x / n).cast("long")


def syscalls(spark: SparkSession, sf_dir: str, by_user: bool = False) -> DataFrame:
    """V1: syscall events.  ``by_user`` gives one run per user (V1u)."""
    e = table(spark, sf_dir, "events").selectExpr(
        "event_id", "ts", "user_id", "event_type AS et", "value", "event_id * 7 + CAST(regexp_extract(props, '(-?[0-9]+)', 1) AS BIGINT) AS h")
    run = "concat('det-', user_id)" if by_user else "concat('det-', user_id, '-', (dayofmonth(ts) - 1) div 6)"
    connect, write = "et = 'signup'", "et = 'purchase'"
    return e.selectExpr(
        "event_id AS seq", "CAST(ts AS TIMESTAMP) AS captured_at", "event_id * 1000 AS timestamp_ns",
        "concat('pkg-', user_id % 60) AS package_name", f"{run} AS detonation_id", f"md5({run}) AS container_id",
        "1000 + event_id % 200 AS pid", "1000 + (event_id % 200) div 3 AS ppid",
        """CASE et WHEN 'view' THEN 'EXECVE' WHEN 'click' THEN 'OPENAT' WHEN 'purchase' THEN 'WRITE' WHEN 'signup' THEN 'CONNECT'
           ELSE CASE h % 10 WHEN 0 THEN 'UNLINK' WHEN 1 THEN 'UNKNOWN' ELSE 'OPENAT' END END AS event_type""",
        f"CASE WHEN et = 'view' THEN {_pick_sql(EXEC_PROCESSES, 'h % 16')} ELSE {_pick_sql(OTHER_PROCESSES, 'h % 6')} END AS process_name",
        f"""CASE WHEN et = 'view' THEN {_pick_sql(EXEC_FILES, 'h % 16')} WHEN et IN ('click', 'error') THEN {_pick_sql(OPEN_FILES, 'h % 24')}
           ELSE '' END AS filename""",
        f"CAST(CASE WHEN {connect} THEN {_pick_sql(CONNECT_IPS, 'h % 8')} ELSE 0 END AS BIGINT) AS connect_ip",
        f"CAST(CASE WHEN {connect} THEN {_pick_sql(CONNECT_PORTS, 'h % 4')} ELSE 0 END AS BIGINT) AS connect_port",
        f"CASE WHEN {write} THEN CAST(floor(value * 10) AS BIGINT) ELSE 0L END AS write_bytes",
        f"CASE WHEN {write} THEN event_id % 6 ELSE 0L END AS write_fd")


def host_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1 as the kernel sees it: raw call names, address family and length, big-endian port."""
    v = syscalls(spark, sf_dir)
    t, seq, port = F.col("event_type"), F.col("seq"), F.col("connect_port")
    call = (F.when(t == "EXECVE", "execve").when((t == "OPENAT") & (seq % 2 == 0), "open").when(t == "OPENAT", "openat")
            .when(t == "CONNECT", "connect").when(t == "WRITE", "write").when(t == "UNLINK", "unlinkat").otherwise("other"))
    return v.select(
        "seq", "detonation_id", "pid", call.alias("syscall"), "filename", "write_fd", "write_bytes", "connect_ip",
        F.when(seq % 5 == 0, 10).otherwise(2).alias("family"), F.when(seq % 7 == 0, 8).otherwise(16).alias("addrlen"),
        (port % 256 * 256 + _floor_div(port, 256)).alias("port_be"))


def package_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: package sources, one file per document, a package per source and hundred documents."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    suffix = F.coalesce(*[F.when(F.col("lang") == k, v) for k, v in SUFFIX_BY_LANG.items()], F.lit(".txt"))
    snippet = _pick(SNIPPETS, (i + _floor_div(i, 20)) % 20)
    return d.select(
        F.concat("source", F.lit("-"), _floor_div(i, 100).cast("string")).alias("package"),
        F.concat(F.when(i % 13 == 0, "node_modules/x/").otherwise(""), F.lit("src/f"), i.cast("string"), suffix).alias("path"),
        F.concat("text", F.lit("\n"), snippet).alias("content"))


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2 manifests: one package.json per package."""
    d = table(spark, sf_dir, "documents")
    block = _floor_div(F.col("doc_id"), 100)
    p = d.select("source", block.alias("block")).distinct()
    number = F.regexp_extract("source", r"(\d+)", 1).cast("long")
    return p.select(F.concat("source", F.lit("-"), F.col("block").cast("string")).alias("package"),
                    F.lit("package.json").alias("path"), _pick(MANIFESTS, (number + F.col("block")) % 4).alias("content"))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: registry snapshot from part."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("long").alias("s"))
    k, s = F.col("k"), F.col("s")
    base = _pick(packs.POPULAR_PACKAGES, k % 45)
    name = (F.when(s % 6 == 0, base).when(s % 6 == 1, F.expr("substring(b, 1, length(b) - 1)"))
            .when(s % 6 == 2, F.concat(F.col("b"), F.right(F.col("b"), F.lit(1)))).when(s % 6 == 3, F.concat(F.lit("x-"), F.col("b")))
            .when(s % 6 == 4, F.concat(F.col("b"), F.lit("-utils"))).otherwise(F.upper("b")))
    published = F.timestamp_micros(
        F.unix_micros(F.lit(AS_OF).cast("timestamp")) - (k % 60) * 86_400_000_000 - s * 3_600_000_000)
    names = F.transform(F.filter(F.array(*[F.lit(i) for i in range(3)]), lambda i: i < k % 4),
                        lambda i: F.concat(F.lit("m"), i.cast("string")))
    return p.withColumn("b", base).select(
        k.alias("part_key"), F.concat(F.lit("pkg-"), k.cast("string")).alias("registry_key"), name.alias("package_name"),
        F.when((k % 29 == 0) & (k > 0), "error").when((k % 31 == 0) & (k > 0), "missing").otherwise("ok").alias("status"),
        F.concat(s.cast("string"), F.lit(".0.0")).alias("latest_version"), s.alias("version_count"),
        F.when(k % 17 != 0, published).alias("latest_published"),
        F.when(k % 7 != 0, k * 37 % 5000).alias("weekly_downloads"), names.alias("maintainers"))


def known_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3 list: two names per part, one and two letters longer than a name of the registry."""
    p = registry(spark, sf_dir).select("package_name", F.md5(F.col("part_key").cast("string")).alias("h"))
    longer = F.array(F.concat("package_name", F.substring("h", 1, 1)), F.concat("package_name", F.substring("h", 2, 2)))
    return p.select(F.explode(longer).alias("name")).distinct()


def damaged_lockfiles(files: DataFrame) -> DataFrame:
    """Every second project's file: JSON without its last character, YAML with an inline block."""
    cut = F.when(F.col("content").startswith("{"), F.substr("content", F.lit(1), F.length("content") - 1)).otherwise(
        F.replace(F.col("content"), F.lit("packages:\n"), F.lit("packages: {a@1.0.0: {dev: false}}\n")))
    number = F.regexp_extract("project", r"(\d+)", 1).cast("long")
    return files.withColumn("content", F.when(number % 2 == 0, cut).otherwise(F.col("content")))


def lock_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: lockfile entries; a project (one lockfile) per hundred parts, keys unique within it."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("long").alias("s"))
    k, s = F.col("k"), F.col("s")
    name = F.concat(F.lit("lib-"), (k * 7 % 60).cast("string"))
    version = F.concat(s.cast("string"), F.lit("."), (k % 10).cast("string"), F.lit(".0"))
    npm_key = (F.when(k % 100 == 0, "").when(s % 4 == 0, F.concat(F.lit("node_modules/"), name))
               .when(s % 4 == 1, F.concat(F.lit("node_modules/a/node_modules/@s/"), name))
               .when(s % 4 == 2, F.concat(F.lit("packages/"), name)).otherwise(name))
    pnpm_key = F.concat(F.when(k % 2 == 0, "/").otherwise(""), F.when(k % 3 == 0, F.concat(F.lit("@s/"), name)).otherwise(name),
                        F.lit("@"), version, F.when(k % 5 == 0, "(peer@1.0.0)").otherwise(""))
    return p.select(
        F.concat(F.lit("proj-"), _floor_div(k, 100).cast("string")).alias("project"), k.alias("part_key"),
        name.alias("name"), version.alias("version"), npm_key.alias("npm_key"), pnpm_key.alias("pnpm_key"),
        F.when(k % 11 == 0, F.concat(F.lit("@own/"), name)).alias("own_name"), (k % 3 == 0).alias("is_dev"))


def _json_map(value: Column) -> Column:
    return F.map_from_entries(F.collect_list(F.struct("entry_key", value)))


def npm_lockfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lockfiles with a ``packages`` map (version 3); at most a hundred entries each."""
    e = lock_entries(spark, sf_dir).groupBy("project", F.col("npm_key").alias("entry_key")).agg(
        F.max("version").alias("version"), F.max("own_name").alias("name"))
    return e.groupBy("project").agg(F.to_json(F.struct(
        F.lit(3).alias("lockfileVersion"), _json_map(F.struct("name", "version")).alias("packages"))).alias("content"))


def npm_v1_lockfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lock_entries(spark, sf_dir).groupBy("project", F.col("name").alias("entry_key")).agg(F.max("version").alias("version"))
    return e.groupBy("project").agg(F.to_json(F.struct(
        F.lit(1).alias("lockfileVersion"), _json_map(F.struct("version")).alias("dependencies"))).alias("content"))


def pnpm_lockfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pnpm YAML texts, with sections before and after ``packages:``."""
    e = lock_entries(spark, sf_dir).select("project", "pnpm_key").distinct()
    block = F.array_join(F.transform(F.array_sort(F.collect_list("pnpm_key")), lambda c: F.concat(
        F.lit("  '"), c, F.lit("':\n    resolution: {integrity: x}\n    dev: false\n"))), "\n")
    return e.groupBy("project").agg(F.concat(
        F.lit("lockfileVersion: '6.0'\n\ndependencies:\n  zzz:\n    version: 1.0.0\n\npackages:\n\n"), block,
        F.lit("\nsettings:\n  auto: true\n")).alias("content"))


def bare_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lock_entries(spark, sf_dir).groupBy("project", "is_dev", F.col("name").alias("entry_key")).agg(F.max("version").alias("version"))
    pick = lambda dev: F.map_from_entries(F.collect_list(F.when(F.col("is_dev") == F.lit(dev), F.struct("entry_key", "version"))))
    return e.groupBy("project").agg(F.to_json(F.struct(
        pick(False).alias("dependencies"), pick(True).alias("devDependencies"))).alias("content"))


def processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: process snapshot; a ternary fork tree over the events, a marker process per 500."""
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", r"(-?\d+)", 1).cast("long")
    i = F.col("event_id")
    exec_file = F.when(i % 500 == 100, packs.MARKER_FILE).otherwise(_pick(EXEC_FILES, (i * 7 + k) % 16))
    return e.select(
        F.concat(F.lit("h"), (i % 2).cast("string")).alias("host"), i.alias("pid"),
        F.when(i > 0, _floor_div(i - 1, 3)).alias("ppid"), F.col("ts").cast("timestamp").alias("fork_ts"),
        exec_file.alias("exec_file"), F.concat(exec_file, F.lit(" --id "), i.cast("string")).alias("cmdline"),
        F.concat(F.lit("mnt-"), (i % 50).cast("string")).alias("mnt_ns"))


def host_processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5 with a fork tree of its own per host, over the same ids."""
    return processes(spark, sf_dir).selectExpr(
        "host", "pid div 2 AS pid", "CASE WHEN pid div 2 > 0 THEN (pid div 2 - 1) div 3 END AS ppid", "fork_ts", "exec_file")


def reused_processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with ids that wrap around, as a kernel's do."""
    return host_processes(spark, sf_dir).selectExpr("host", f"pid % {MAX_PID} AS pid", f"ppid % {MAX_PID} AS ppid", "fork_ts", "exec_file")


def run_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8: start, end, success and log text per run; m is the run's first event."""
    r = syscalls(spark, sf_dir).groupBy("detonation_id").agg(
        F.min("captured_at").alias("started_at"), F.max("captured_at").alias("ended_at"), F.min("seq").alias("m"),
        F.max("package_name").alias("package_name"), F.max("container_id").alias("container_id"))
    m = F.col("m")
    # every third line carries a frame header: byte 1 and seven letters
    line = lambda i: F.concat(F.when(i % 3 == 0, "\x01AAAAAAA").otherwise(""), F.lit("line"), i.cast("string"))
    lines = F.when(m % 50 > 0, F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), m % 50), line), "\n")).otherwise("")
    return r.select("detonation_id", "package_name", "container_id", "started_at", "ended_at", "m",
                    (m % 9 != 0).alias("success"), lines.alias("log"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6: answers of an external model, by run; no row when m % 7 = 0."""
    m = F.col("m")
    r = run_bounds(spark, sf_dir).filter(m % 7 != 0)
    body = lambda score, risk, severity: (
        '{"threat_score": %s, "risk_level": "%s", "findings": [{"severity": "%s", "category": "recon", '
        '"description": "d1", "evidence": "e1", "mitre_id": "T1082"}, {"description": "d2"}], '
        '"recommendation": "check it"}' % (score, risk, severity))
    good = body(42, "suspicious", "HIGH")
    text = (F.when(m % 7 == 1, good).when(m % 7 == 2, "```json\n" + good + "\n```").when(m % 7 == 3, "no idea, sorry")
            .when(m % 7 == 4, body(150, "MALICIOUS", "CRITICAL")).when(m % 7 == 5, body(-5, "weird", "MEDIUM"))
            .otherwise(body(20, "SAFE", "low")))
    return r.select("detonation_id", text.alias("response"))


def chain_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("m")
    r = run_bounds(spark, sf_dir).filter(m % 3 != 0)
    full = '{"executive_summary": "steals keys", "attack_chain": ["Stage 1", "Stage 2", "Stage 3"]}'
    return r.select("detonation_id", F.when(m % 3 == 1, full).otherwise('{"executive_summary": "only words"}').alias("response"))


def cgroup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7: cgroup lines of the process ids, from all orders."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    k = F.col("k")
    pid = 1000 + k % 250
    digest = F.md5(pid.cast("string").cast("binary"))
    shape = (k + _floor_div(k, 250)) % 5
    line = (F.when(pid % 10 == 9, "0::/user.slice")
            .when(shape == 0, F.concat(F.lit("0::/system.slice/docker-"), digest, digest, F.lit(".scope")))
            .when(shape == 1, F.concat(F.lit("0::/docker/"), digest, digest))
            .when(shape == 2, F.concat(F.lit("0::/containerd/"), digest, digest))
            .when(shape == 3, "0::/user.slice").otherwise("0::/docker/short"))
    return o.select(pid.alias("pid"), k.alias("line_no"), line.alias("line"))


def undelivered_flag() -> Column:
    """Events that the fixture treats as lost on the way to the topic."""
    return F.col("seq") % 11 == 3


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1 as topic messages, some damaged: cut JSON, missing field, numbers as text."""
    v = syscalls(spark, sf_dir)
    seq = F.col("seq")
    text = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    fields = [c for c in ("package_name", "container_id", "detonation_id", "pid", "ppid", "timestamp_ns", "event_type",
                          "process_name", "filename")]
    event = F.struct(
        *[F.when(seq % 19 != 0, F.col(c)).alias(c) if c == "ppid"
          else F.when(seq % 29 == 0, F.lit("abc")).otherwise(F.col(c).cast("string")).alias(c) if c == "pid"
          else F.col(c) for c in fields],
        text("captured_at").alias("captured_at"),
        F.when(F.col("connect_port") != 0, F.col("connect_port")).alias("connect_port"),
        F.when(F.col("connect_ip") != 0, F.col("connect_ip")).alias("connect_ip"),
        "write_bytes", "write_fd")
    whole = F.to_json(event)
    return v.select("seq", F.when(seq % 17 == 0, F.substring(whole, 1, 40)).otherwise(whole).alias("value"))
