"""Sources and sinks on small files."""

import json
import struct

from pyspark.sql import functions as F

from sysloom.functions import columns as fx
from sysloom.operators import dependencies, registry as registry_ops, reports as report_ops, rules, telemetry
from sysloom.sources import lockfiles, raw_records, registry, reports, syscalls

EVENT = {"package_name": "p", "container_id": "c", "detonation_id": "d", "pid": 4294967295, "ppid": "12", "timestamp_ns": 5,
         "event_type": "EXECVE", "process_name": "sh"}


def decode(spark, *values):
    raw = spark.createDataFrame(list(enumerate(values)), "seq long, value string")
    events, rejects = syscalls.decode_syscalls(raw)
    return {r.seq: r for r in events.collect()}, {r.seq: r.reason for r in rejects.collect()}


def test_decode(spark):
    good = json.dumps(EVENT)
    events, rejects = decode(spark, good, good[:20], "[]", "null", "12", json.dumps({k: v for k, v in EVENT.items() if k != "pid"}),
                             json.dumps({**EVENT, "connect_port": "x"}), json.dumps({**EVENT, "connect_ip": 9, "extra": {}}), "")
    assert set(events) == {0, 7} and set(rejects) == {1, 2, 3, 4, 5, 6, 8}
    first = events[0]
    assert (first.pid, first.ppid, first.filename, first.connect_ip, first.captured_at) == (4294967295, 12, "", 0, "")
    assert events[7].connect_ip == 9
    assert rejects[5] == "missing field" and rejects[6] == "not a number" and rejects[1] == "malformed"


def test_publish_and_read_back(spark, events, tmp_path):
    sent = events([("EXECVE", "sh", "/bin/id"), ("CONNECT", "node", "", {"connect_ip": 134744072, "connect_port": 53})])
    syscalls.publish_syscalls(sent, directory=str(tmp_path / "topic"))
    back, rejects = syscalls.decode_syscalls(syscalls.read_syscall_history(spark, directory=str(tmp_path / "topic")))
    assert rejects.count() == 0
    back = syscalls.with_arrival_order(back.withColumn("captured_at", F.lit("2024-01-01T10:00:00.123456789+02:00")))
    assert rules.verdicts(back).first().threat_score == rules.verdicts(sent).first().threat_score == 30
    assert back.select(F.unix_micros("captured_at")).first()[0] == 1704096000123456


def test_raw_records_golden(spark):
    def record(pid, comm, name, port=0, ip=0, nbytes=0, fd=0, kind=2):
        return struct.pack("<IIQI16s256sII4xQi4x", pid, 7, 2**40 + 1, kind, comm, name, port, ip, nbytes, fd)

    rows = [record(4294967295, b"node\0junk", b"/etc/\xc3\xa9\0rest", 443, 134744072, 2**33, -1),
            record(1, b"x" * 16, b"\xff\x80\xc3\x01/a\0", kind=9), b"short"]
    assert len(rows[0]) == 320
    df = spark.createDataFrame(list(enumerate(map(bytearray, rows))), "n int, record binary")
    got = {r.n: r for r in raw_records.decode_raw_records(df).collect()}
    a = got[0]
    assert (a.pid, a.ppid, a.timestamp_ns, a.event_type) == (4294967295, 7, 2**40 + 1, "OPENAT")
    assert (a.process_name, a.filename) == ("node", "/etc/é")
    assert (a.connect_port, a.connect_ip, a.write_bytes, a.write_fd) == (443, 134744072, 2**33, -1)
    assert got[1].process_name == "x" * 16 and got[1].event_type == "UNKNOWN" and got[1].filename.endswith("/a")
    assert 2 not in got


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_lockfile_dialects(spark, tmp_path):
    write(tmp_path / "a" / "package-lock.json", json.dumps({"lockfileVersion": 3, "packages": {
        "": {"name": "root"}, "node_modules/x": {"version": "1.0.0"}, "node_modules/y/node_modules/@s/z": {"version": "2.0.0"},
        "libs/w": {"name": "node_modules/own", "version": "3.0.0"}}}))
    write(tmp_path / "b" / "package-lock.json", json.dumps({"lockfileVersion": 1, "dependencies": {"old": {"version": "0.1.0"}}}))
    write(tmp_path / "c" / "pnpm-lock.yaml",
          "lockfileVersion: 5.4\npackages:\n\n  # note\n  /lodash@4.17.21:\n    resolution: {integrity: a}\n  lodash@4.17.20:\n    dev: true\n"
          "  '@types/node@18.0.0':\n    dev: true\n\n  /express@4.18.2(debug@4.3.4):\n    dependencies:\n      ms: 1.0.0\n  \"quoted@1.0.0\": {}\n"
          "  bare:\n    x: 1\nsnapshots:\n  no@1.0.0: {}\n")
    write(tmp_path / "d" / "package.json", json.dumps({"dependencies": {"m": "^1", "n": "1"}, "devDependencies": {"m": "^2"}}))
    write(tmp_path / "e" / "package-lock.json", "{ broken")
    locks = lockfiles.read_lockfiles(spark, str(tmp_path / "*" / "*"))
    got = {}
    for r in lockfiles.lockfile_targets(locks).collect():
        got.setdefault(r.project.split("/")[-2], set()).add((r.name, r.version))
    assert got == {
        "a": {("x", "1.0.0"), ("@s/z", "2.0.0"), ("own", "3.0.0")}, "b": {("old", "0.1.0")},
        # of two entries with one name the greater key wins
        "c": {("lodash", "4.17.20"), ("@types/node", "18.0.0"), ("express", "4.18.2"), ("quoted", "1.0.0"), ("bare", "")},
        "d": {("m", "^2"), ("n", "1")}}


def test_targets_limit_and_versions(spark):
    t = spark.createDataFrame([("p", k, k[0], k[1]) for k in ("a1", "a2", "b1", "c1")], "project string, lock_key string, name string, version string")
    distinct = dependencies.distinct_targets(t)
    assert {(r.name, r.version) for r in distinct.collect()} == {("a", "2"), ("b", "1"), ("c", "1")}
    assert dependencies.distinct_targets(t, per_version=True).count() == 4
    two = dependencies.limit_targets(distinct, 2).collect()
    assert {(r.name, r.total) for r in two} == {("a", 3), ("b", 3)}
    assert dependencies.limit_targets(distinct, 0).count() == 3


def test_registry_documents(spark, tmp_path):
    docs = [
        {"name": "a", "dist-tags": {"latest": "2.0.0"}, "versions": {"1.0.0": {"x": 1}, "2.0.0": {}}, "time": {"2.0.0": "2024-01-25T12:00:00.000Z"},
         "maintainers": [{"name": "m"}], "weekly_downloads": 99},
        {"name": "b", "dist-tags": {"latest": "1.0.0"}, "time": {"1.0.0": "2024-01-25T12:00:00"}, "maintainers": [{"email": "e"}]},
        {"name": "c", "error": "Not found"}, {"name": "d", "dist-tags": {}},
        {"name": "lodahs", "dist-tags": {"latest": "1"}, "time": {"1": "2024-02-01T00:00:00+01:00"}, "maintainers": [{"name": "x"}, {"name": "y"}]}]
    (tmp_path / "dump.json").write_text("\n".join(json.dumps(d) for d in docs) + "\n{ broken\n")
    table = registry.read_registry(spark, str(tmp_path / "dump.json"))
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp")
    rows = {r.registry_key: r for r in registry_ops.registry_summary(table, as_of).collect()}
    assert (rows["a"].age_days, rows["a"].total_versions, rows["a"].weekly_downloads) == (5, 2, 99)
    assert rows["b"].age_days is None and rows["b"].maintainer_names == "?"
    assert rows["c"].available is False and rows["d"].latest_version == "unknown"
    # published after as_of: rounded down to the day before
    assert rows["lodahs"].age_days == -1 and rows["lodahs"].typosquat_target == "lodash"
    signals = {}
    for r in registry_ops.metadata_findings(table, as_of).collect():
        signals.setdefault(r.registry_key, []).append((r.ordinal, r.severity))
    assert sorted(signals["a"]) == [(2, "HIGH"), (3, "HIGH"), (4, "LOW")]
    assert signals["c"] == [(1, "MEDIUM")] and sorted(signals["b"]) == [(4, "LOW")]
    assert sorted(signals["lodahs"]) == [(2, "HIGH"), (5, "HIGH")]


def test_report_files_with_damage(spark, tmp_path):
    write(tmp_path / "r1.json", json.dumps({"package_name": "p", "threat_score": 61, "risk_level": "MALICIOUS", "findings": [{}, {}],
                                            "analyzed_at": "2024-01-02T00:00:00Z", "events_analyzed": 5}, indent=2))
    write(tmp_path / "r2.json", json.dumps({"package_name": 5, "threat_score": "high"}))
    write(tmp_path / "r3.json", "{ broken")
    write(tmp_path / "r4.txt", "{}")
    write(tmp_path / "deep" / "r5.json", "{}")
    index = report_ops.report_index(reports.read_report_files(spark, str(tmp_path))).collect()
    assert [r.report_id for r in index] == ["r1", "r2"]
    assert (index[0].threat_score, index[0].findings, index[0].events_analyzed) == (61, 2, 5)
    assert (index[1].threat_score, index[1].findings, index[1].risk_level) == (0, 0, "")


def documents(events, run, n, limit=10_000):
    v = events([("UNLINK", "sh", f"/f{i}") for i in range(n)] + [("EXECVE", "sh", "nc")], run=run)
    return report_ops.report_documents(rules.verdicts(v), rules.findings(v), F.lit("2024-01-01 00:00:00").cast("timestamp"), limit)


def test_reports_replace_and_replay(spark, events, tmp_path):
    path = str(tmp_path / "reports")
    reports.write_reports(documents(events, "a/b", 3), path, 0)
    reports.write_reports(documents(events, "other", 1), path, 1)
    reports.write_reports(documents(events, "a/b", 1), path, 2)
    reports.write_reports(documents(events, "a/b", 2), path, 2)
    rows = {r.report_id: r for r in reports.read_reports(spark, path).collect()}
    assert set(rows) == {"a_b", "other"} and len(rows["a_b"].findings) == 3
    assert rows["a_b"].findings[0].severity == "CRITICAL" and rows["a_b"].detonation_id == "a/b"
    wanted = spark.createDataFrame([("x/a_b.json",), ("nope",)], "request string")
    assert report_ops.report_by_id(reports.read_reports(spark, path), wanted).count() == 1


def test_large_reports_come_in_whole_parts(events):
    n = 9_000
    one = documents(events, "big", n).collect()
    parts = documents(events, "big", n, limit=100).orderBy("part_no").collect()
    assert len(one) == 1 and len(parts) > 1
    assert [f for p in parts for f in p.findings] == one[0].findings and len(one[0].findings) == n + 1
    assert [len(p.findings) for p in parts] == [100] * 90 + [1] and [p.part_no for p in parts] == list(range(91))


def test_large_report_is_one_index_row(events):
    index = report_ops.report_index(documents(events, "big", 500, limit=10)).collect()
    assert len(index) == 1 and index[0].findings == 501


def test_container_id_lines(spark):
    h = "0123456789abcdef" * 4
    lines = {f"0::/system.slice/docker-{h}.scope": h[:12], f"0::/docker/{h}": h[:12], f"1:x:/containerd/{h}": h[:12], "0::/docker/short": "",
             f"0::/docker-abc.d/docker/{h}": h[:12], "0::/user.slice": "", f"docker-x.{h}": ""}
    df = spark.createDataFrame([(k,) for k in lines], "line string")
    assert {r.line: r.id for r in df.select("line", fx.container_id("line").alias("id")).collect()} == lines


def test_names_specs_and_frames(spark):
    df = spark.createDataFrame([("@nest/core",), ("._-",), ("",), ("a b",)], "s string")
    assert [r[0] for r in df.select(fx.sanitize_name("s")).collect()] == ["nest-core", "pkg", "pkg", "a-b"]
    specs = spark.createDataFrame([("a@1",), ("@s/a",), ("@s/a@1",), ("a",)], "s string")
    name, version = fx.split_spec("s")
    assert [tuple(r) for r in specs.select(name, version).collect()] == [("a", "1"), ("@s/a", ""), ("@s/a", "1"), ("a", "")]
    framed = spark.createDataFrame([("\x01\0\0\0\0\0\0\x05hello é",), ("\x01234567",), ("plain text line",), ("",)], "s string")
    assert [r[0] for r in framed.select(fx.strip_frame_header("s")).collect()] == ["hello é", "\x01234567", "plain text line", ""]
    logs = spark.createDataFrame([("",), ("a",), ("\na\n\nb\n",), (" ",)], "s string")
    assert [r[0] for r in logs.select(fx.count_lines("s")).collect()] == [0, 1, 3, 1]


def test_strip_takes_all_white_space(spark):
    text = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2003\u2028\u2029\u202f\u205f\u3000"
    df = spark.createDataFrame([(text + "a b" + text,)], "s string")
    assert df.select(fx.strip_ws("s")).first()[0] == (text + "a b" + text).strip() == "a b"


def test_preview(spark, events):
    v = events([("EXECVE", "sh", "/" + "x" * 60), ("LONGTYPE", "a process name of length", None)])
    assert [r.line for r in telemetry.preview_telemetry(v, 5).collect()] == [
        "EXECVE | sh              → /" + "x" * 49, "LONGTYPE | a process name of length → ?"]
