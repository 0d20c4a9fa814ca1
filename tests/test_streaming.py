"""Streams: sessions, scoring equal to batch, replays, processing-time sessions."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from sysloom.operators import rules, sessions
from sysloom.sources import syscalls
from sysloom.streaming import idle, verdicts
from sysloom.streaming.log_table import LogTable

NOW = {"availableNow": True}


def message(run, second, i, kind="EXECVE", file="/bin/sh", package="pkg"):
    return json.dumps({
        "package_name": package, "container_id": "c", "detonation_id": run, "pid": 100 + i, "ppid": 1, "timestamp_ns": second * 10**9 + i,
        "event_type": kind, "process_name": "sh", "filename": file, "captured_at": f"2024-01-01T00:{second // 60:02d}:{second % 60:02d}Z"})


def put(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


FIELDS = ("report_id", "session_start", "threat_score", "risk_level", "events_analyzed", "analysis_method", "package_name")


def run(spark, base, **options):
    raw = syscalls.read_syscall_stream(spark, directory=str(base / "topic"), max_files_per_trigger=1)
    answers = syscalls.read_syscall_stream(spark, directory=str(base / "answers"), max_files_per_trigger=1) if (base / "answers").exists() else None
    q = verdicts.run_verdicts(raw, str(base / "tables"), str(base / "ck"), answers, NOW, delay_seconds=10, **options)
    assert q.awaitTermination(300)
    return verdicts.VerdictTables.under(spark, str(base / "tables"), options.get("fan", 32))


def plain(documents):
    return sorted((*(r[f] for f in FIELDS), tuple(map(tuple, r.findings))) for r in documents.collect())


def close(spark, tables, **options):
    """End of input: everything is closed."""
    version = 1 + max(hi for _, hi in tables.sessions.spans())
    verdicts.advance(tables, version, close_all=True, **options)


def events_of(spark, base):
    raw = syscalls.read_syscall_history(spark, directory=str(base / "topic"))
    return verdicts.decode_batch(raw)[0]


def test_stream_equals_batch(spark, tmp_path):
    put(tmp_path / "topic", "1.json", [
        message("a", 0, 0, file="/usr/bin/curl"), message("a", 5, 1, "OPENAT", "/etc/shadow"), "{ broken",
        message("a", 13, 2, file="nc"),  # exactly the gap: same session
        message("b", 1, 3, file="/bin/sh"), message("x/y", 2, 4, file="/bin/id")])
    # a far later event moves the watermark past the sessions above
    put(tmp_path / "topic", "2.json", [message("late", 600, 9)])
    tables = run(spark, tmp_path)
    got = {r.report_id: r for r in verdicts.current_reports(tables).collect()}
    assert set(got) == {"a", "b", "x_y"}
    events, _ = syscalls.decode_syscalls(syscalls.read_syscall_history(spark, directory=str(tmp_path / "topic")))
    batch = {r.detonation_id: r for r in rules.verdicts(syscalls.with_arrival_order(events)).collect()}
    for row in got.values():
        want = batch[row.detonation_id]
        assert (row.threat_score, row.risk_level, row.events_analyzed) == (want.threat_score, want.risk_level, want.events_analyzed)
        assert len(row.findings) == want.finding_count
    assert got["a"].threat_score == 75 and got["a"].findings[0].severity == "CRITICAL"
    assert [r.reason for r in tables.rejects.read().collect()] == ["malformed"]
    # a second session of the same run replaces its report
    put(tmp_path / "topic", "3.json", [message("a", 700, 1, file="/bin/whoami"), message("end", 2000, 1)])
    got = {r.report_id: r for r in verdicts.current_reports(run(spark, tmp_path)).collect()}
    assert set(got) == {"a", "b", "x_y", "late"}
    assert (got["a"].threat_score, got["a"].events_analyzed) == (10, 1)


def test_late_events_end_in_the_report(spark, tmp_path):
    put(tmp_path / "topic", "1.json", [message("a", 0, 0), message("a", 20, 1), message("b", 0, 2), message("c", 0, 8)])
    put(tmp_path / "topic", "2.json", [message("clock", 3000, 3)])
    tables = run(spark, tmp_path)
    assert {(r.report_id, r.events_analyzed) for r in verdicts.current_reports(tables).collect()} == {("a", 1), ("b", 1), ("c", 1)}
    # an hour late: joins the two sessions of a, extends b, stands alone before c's, opens d
    put(tmp_path / "topic", "3.json", [
        message("clock", 3600, 3), message("a", 7, 4, file="/usr/bin/curl"), message("a", 13, 5), message("b", 4, 6, "OPENAT", "/etc/shadow"),
        message("c", 30, 7, file="nc"), message("d", 1, 9)])
    tables = run(spark, tmp_path)
    got = {r.report_id: r for r in verdicts.current_reports(tables).collect()}
    assert {k: r.events_analyzed for k, r in got.items()} == {"a": 4, "b": 2, "c": 1, "d": 1, "clock": 1}
    assert got["a"].threat_score > 0 and got["b"].threat_score > 0
    close(spark, tables)
    assert plain(verdicts.current_reports(tables)) == plain(verdicts.batch_reports(events_of(spark, tmp_path)))


def shuffled(seed, files, size):
    rnd = random.Random(seed)
    names = ["/bin/sh", "/usr/bin/curl", "nc", "/bin/id", "/usr/bin/wget"]
    lines = [message(rnd.choice("abc"), rnd.randrange(0, 900), i, rnd.choice(["EXECVE", "OPENAT"]), rnd.choice(names + ["/etc/shadow"]), f"p{i % 3}")
             for i in range(files * size)]
    rnd.shuffle(lines)
    return [lines[k::files] for k in range(files)]


def test_any_order_of_arrival_gives_the_batch_result(spark, tmp_path):
    for k, lines in enumerate(shuffled(1, 4, 40)):
        put(tmp_path / "topic", f"{k}.json", lines)
    tables = run(spark, tmp_path, fan=2)
    events = events_of(spark, tmp_path)
    close(spark, tables)
    want = {tuple(r) for r in sessions.sessionize(events).select("detonation_id", "session_start", "session_last", "events", "package_name").collect()}
    assert {tuple(r) for r in verdicts.closed_sessions(tables).collect()} == want and len(want) > 20
    assert plain(verdicts.current_reports(tables)) == plain(verdicts.batch_reports(events))
    assert verdicts.active_sessions(tables).count() == 0


def test_open_sessions_equal_the_batch_view_at_each_step(spark, tmp_path):
    parts = [[(f"r{i % 2}", s + i, i) for i in range(4)] for s in (0, 6, 30, 33, 2, 300)]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.createDataFrame([], verdicts.EVENT_TABLE_SCHEMA).schema)
    blank = spark.createDataFrame([], schema)
    tables, so_far = verdicts.VerdictTables.under(spark, str(tmp_path / "t")), blank
    for version, rows in enumerate(parts):
        batch = spark.createDataFrame(rows, "detonation_id string, s long, seq long").select(
            "detonation_id", "seq", F.timestamp_seconds("s").alias("captured_at"), F.lit("EXECVE").alias("event_type"),
            F.concat(F.lit("p"), "seq").alias("package_name"), F.lit("sh").alias("process_name"), F.lit("/bin/sh").alias("filename"))
        batch = blank.unionByName(batch, allowMissingColumns=True)
        so_far = so_far.unionByName(batch)
        verdicts.advance(tables, version, batch, gap_seconds=8, delay_seconds=10)
        top = so_far.agg(F.unix_micros(F.max("captured_at"))).first()[0]
        view = sessions.sessionize(so_far).filter(F.unix_micros("session_last") + 8_000_000 >= top - 10_000_000)
        columns = ["detonation_id", "session_start", "session_last", "events", "package_name"]
        assert {tuple(r) for r in verdicts.active_sessions(tables).collect()} == {tuple(r) for r in view.select(*columns).collect()}
    changes = [(r.version, r.events, r.status) for r in verdicts.session_changes(tables).filter("detonation_id = 'r0'").collect()]
    assert {(0, 2, "open"), (1, 4, "open"), (4, 6, "closed"), (2, 2, "open"), (3, 4, "open"), (5, 2, "open"), (5, 4, "closed")} <= set(changes)


def test_intervals_and_session_events_are_computed_once(spark, tmp_path, monkeypatch):
    put(tmp_path / "topic", "1.json", [message("a", k * 3, k) for k in range(9)] + [message("b", k * 20, k) for k in range(3)])
    events, plans = events_of(spark, tmp_path), {"joined": [], "scored": []}
    plan, join_intervals = lambda df: df._jdf.queryExecution().optimizedPlan().toString(), sessions.join_intervals
    monkeypatch.setattr(sessions, "join_intervals", lambda rows, *given: plans["joined"].append(plan(rows)) or join_intervals(rows, *given))
    score = lambda keyed, **given: plans["scored"].append(plan(keyed)) or verdicts.score_batch(keyed, **given)
    tables = verdicts.VerdictTables.under(spark, str(tmp_path / "tables"))
    for version in range(2):
        verdicts.advance(tables, version, events.filter(F.col("seq") % 2 == version), score=score, close_all=version == 1)
    # both are read several times: what is read is a table, not the windows and joins that made it
    assert len(plans["joined"]) == 2 and not any("Window" in p for p in plans["joined"])
    assert plans["scored"] and not any("Join" in p for p in plans["scored"])
    assert plain(verdicts.current_reports(tables))[0][:5] == plain(verdicts.batch_reports(events))[0][:5]
    assert {(r.detonation_id, r.session_start, r.events) for r in verdicts.closed_sessions(tables).collect()} == {
        (r.detonation_id, r.session_start, r.events) for r in sessions.sessionize(events).collect()}


def test_replayed_versions_add_nothing(spark, tmp_path):
    schema = spark.createDataFrame([], verdicts.EVENT_TABLE_SCHEMA).schema
    raw = lambda lines: spark.createDataFrame([(None, x, "2024-01-01 00:00:00") for x in lines], "seq long, value string, t string").select(
        "seq", "value", F.col("t").cast("timestamp").alias("arrived_at"))
    once, twice = (verdicts.VerdictTables.under(spark, str(tmp_path / n), 2) for n in ("one", "two"))
    for k, lines in enumerate(shuffled(2, 3, 20)):
        lines = [*lines, message("n", k, 900 + k).replace("2024-01-01T", "never ")]
        events = verdicts.decode_batch(raw(lines))[0]
        verdicts.advance(once, k, events, analyzed_at=F.lit("2024-02-02").cast("timestamp"))
        for day in ("2024-02-02", "2024-03-03"):
            verdicts.advance(twice, k, events, analyzed_at=F.lit(day).cast("timestamp"))
    assert plain(verdicts.current_reports(once)) == plain(verdicts.current_reports(twice))
    for a, b in zip(once.all()[:4], twice.all()[:4]):
        assert sorted(map(str, a.read().collect())) == sorted(map(str, b.read().collect()))
    assert once.events.schema.names == [*schema.names, "version"]


def test_answers_join_by_run_and_session(spark, tmp_path):
    lines = [message("a", 0, 0, file="/usr/bin/curl"), message("a", 1, 1, "OPENAT", "/home/u/x"), message("b", 0, 2, file="/bin/whoami"),
             message("m", 0, 3, "OPENAT", "/etc/shadow"), message("m", 1, 4, file="nc"), message("m", 2, 5, file="/usr/bin/curl")]
    put(tmp_path / "topic", "1.json", lines)
    put(tmp_path / "topic", "2.json", [message("clock", 3000, 9)])
    start = 1704067200 * 10**6
    answer = lambda run, at, score, chain=False: json.dumps({"detonation_id": run, "session_start": at, "chain": chain, "response": json.dumps(
        {"executive_summary": "s", "attack_chain": ["one"]} if chain else {"threat_score": score, "risk_level": "MALICIOUS", "findings": [{"description": "d"}]})})
    (tmp_path / "answers").mkdir()
    tables = run(spark, tmp_path)
    before = {r.report_id: r for r in verdicts.current_reports(tables).collect()}
    assert before["a"].analysis_method == "rules only (LLM error: no answer)" and before["m"].attack_chain == []
    put(tmp_path / "answers", "1.json", [answer("a", start, 77), answer("a", start + 1, 5), answer("m", start, 0, True), "{ broken"])
    tables = run(spark, tmp_path)
    got = {r.report_id: r for r in verdicts.current_reports(tables).collect()}
    assert (got["a"].threat_score, [f.description for f in got["a"].findings]) == (77, ["d"])
    assert got["m"].executive_summary == "s" and got["m"].threat_score == before["m"].threat_score and got["b"].threat_score == before["b"].threat_score
    close(spark, tables)
    answers = verdicts.decode_answers(syscalls.read_syscall_history(spark, directory=str(tmp_path / "answers")))
    want = verdicts.batch_reports(events_of(spark, tmp_path), answers.filter("session_start is not null"))
    assert plain(verdicts.current_reports(tables)) == plain(want)


def test_versions_are_merged_and_stay_few(spark, tmp_path):
    table = LogTable(spark, str(tmp_path / "t"), "k long, v long", ("k",), fan=4)
    for version in range(35):
        table.compact(version)
        # each key is written again and again, 3 leaves at some time
        table.append(spark.createDataFrame([(version % 5, version), (100 + version, version)], "k long, v long").coalesce(1), version)
        assert len(table.spans()) <= 4 * 4
    folders = [x for x in (tmp_path / "t").iterdir()]
    assert len(folders) <= 2 * 4 * 4 and table.spans()[0] == (0, 15)
    latest = {r.k: r.v for r in table.latest().collect()}
    assert latest == {**{k: max(v for v in range(35) if v % 5 == k) for k in range(5)}, **{100 + v: v for v in range(35)}}
    # a version that has been merged is not written again
    table.append(spark.createDataFrame([(1, -1)], "k long, v long"), 3)
    assert {r.k: r.v for r in table.latest().collect()} == latest
    assert {r.v for r in table.read(before=10, first=8).collect()} == set() and table.at(34).count() == 2


def test_incomplete_folders_do_not_count(spark, tmp_path):
    table = LogTable(spark, str(tmp_path / "t"), "k long", fan=2)
    table.append(spark.range(3).withColumnRenamed("id", "k"), 0)
    broken = tmp_path / "t" / f"{1:012d}-{1:012d}"
    broken.mkdir()
    (broken / "part-0.parquet").write_text("half")
    assert table.read().count() == 3
    table.append(spark.range(2).withColumnRenamed("id", "k"), 1)
    assert table.read().count() == 5


def test_pipeline_order_metadata_then_answers(spark, events):
    # a name far from every popular one ("pkg" would be two edits from "pm2")
    v = events([("EXECVE", "sh", "curl", {"package_name": "quiet-package"})])
    table = spark.createDataFrame([("quiet-package", "quiet-package", "ok", "1", 1, None, 50, ["m"])],
                                  "registry_key string, package_name string, status string, latest_version string, version_count long, "
                                  "latest_published timestamp, weekly_downloads long, maintainers array<string>")
    scored, found = verdicts.score_batch(v, table)
    report = verdicts.report_batch(scored, found).first()
    assert (report.threat_score, report.risk_level) == (25, "SAFE")
    assert [f.severity for f in report.findings] == ["HIGH", "HIGH", "LOW"] and report.findings[0].evidence.startswith("execve")
    answers = spark.createDataFrame([("r1", '{"threat_score": 80, "risk_level": "MALICIOUS", "findings": [{"description": "d"}]}')],
                                    "detonation_id string, response string")
    chains = spark.createDataFrame([("r1", '{"executive_summary": "s", "attack_chain": ["one"]}')], "detonation_id string, response string")
    report = verdicts.report_batch(*verdicts.score_batch(v, table, responses=answers, chains=chains)).first()
    assert (report.threat_score, report.executive_summary, report.attack_chain) == (80, "s", ["one"])
    assert [f.description for f in report.findings] == ["d"] and report.analysis_method == "hybrid (rules + LLM attack chain)"


def test_sessions_match_session_window(spark):
    rows = [(f"r{i % 3}", (i * i * 37) % 4000, i) for i in range(300)]
    df = spark.createDataFrame(rows, "detonation_id string, t long, seq long").select(
        "detonation_id", "seq", F.timestamp_millis(F.col("t") * 1000).alias("captured_at"), F.lit("p").alias("package_name"))
    ours = {(r.detonation_id, r.a, r.b, r.events) for r in sessions.sessionize(df).select(
        "detonation_id", F.unix_micros("session_start").alias("a"), F.unix_micros("session_last").alias("b"), "events").collect()}
    built_in = df.groupBy("detonation_id", F.session_window("captured_at", "8 seconds").alias("w")).agg(
        F.unix_micros(F.min("captured_at")).alias("a"), F.unix_micros(F.max("captured_at")).alias("b"), F.count("*").alias("events"))
    assert ours == {(r.detonation_id, r.a, r.b, r.events) for r in built_in.collect()} and len(ours) > 10


def test_session_gap_is_strict_and_last_event_names_package(spark):
    at = lambda ms: f"2024-01-01 00:00:{ms / 1000:06.3f}"
    rows = [("r", at(0), 1, "a"), ("r", at(8000), 2, "b"), ("r", at(16001), 3, "c"), ("r", at(15999), 4, "d")]
    df = spark.createDataFrame(rows, "detonation_id string, t string, seq long, package_name string").withColumn("captured_at", F.col("t").cast("timestamp"))
    assert [(r.events, r.package_name) for r in sessions.sessionize(df).collect()] == [(4, "d")]
    apart = df.filter("seq <> 4")
    assert {(r.events, r.package_name) for r in sessions.sessionize(apart).collect()} == {(2, "b"), (1, "c")}


def test_one_run_of_a_million_slots(spark):
    step = 5_000_000
    gaps = 9
    rows = spark.range(0, 1_000_000, numPartitions=8).select(
        F.lit("r").alias("detonation_id"), F.col("id").alias("seq"), F.lit("p").alias("package_name"),
        # every 100,000 events a silence
        F.timestamp_micros(F.col("id") * step + F.floor(F.col("id") / 100_000).cast("long") * gaps * 1_000_000).alias("captured_at"))
    found = sessions.sessionize(rows)
    got = sorted((r.a, r.b, r.events) for r in found.select(F.unix_micros("session_start").alias("a"), F.unix_micros("session_last").alias("b"), "events").collect())
    want = [((k * 100_000) * step + k * gaps * 10**6, (k * 100_000 + 99_999) * step + k * gaps * 10**6, 100_000) for k in range(10)]
    assert got == want


@pytest.mark.parametrize("block_slots", [1, 2, 7])
def test_sessions_cross_block_edges(spark, block_slots):
    rnd = random.Random(block_slots)
    rows = [(f"r{i % 3}", rnd.randrange(0, 3000) * 250, i) for i in range(700)] + [("neg", -5000, 1), ("neg", 3000, 2), (None, 1, 3)]
    df = spark.createDataFrame(rows, "detonation_id string, t long, seq long").select(
        "detonation_id", "seq", F.timestamp_millis(F.col("t")).alias("captured_at"), F.lit("p").alias("package_name"))
    view = lambda d: {(r.detonation_id, r.session_start, r.session_last, r.events) for r in d.collect()}
    whole = {}
    for run_id, t, _ in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        known = whole.setdefault(run_id, [])
        if known and t - known[-1][1] <= 1000:
            known[-1] = (known[-1][0], t, known[-1][2] + 1)
        else:
            known.append((t, t, 1))
    got = view(sessions.sessionize(df, 1.0, block_slots=block_slots).select(
        "detonation_id", F.unix_millis("session_start").alias("session_start"), F.unix_millis("session_last").alias("session_last"), "events"))
    assert got == {(k, *x) for k, found in whole.items() for x in found}


def test_idle_sessions(spark, tmp_path):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder = tmp_path / "in"
    folder.mkdir()
    schema = "detonation_id string, package_name string, seq long"
    add = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(folder))
    add([("r", "a", 1), ("r", "b", 2)])
    stream = spark.readStream.schema(schema).json(str(folder))
    q = idle.sessionize_idle(stream, gap_seconds=2).writeStream.outputMode("update").format("memory").queryName("idle").option(
        "checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="500 milliseconds").start()

    def rows_until(n):
        deadline = time.time() + 90
        while time.time() < deadline:
            rows = [tuple(r) for r in spark.sql("SELECT session, package_name, events, status FROM idle").collect()]
            if len(rows) >= n:
                return rows
            time.sleep(0.5)
        raise AssertionError(f"still {rows}")

    try:
        assert rows_until(2) == [(0, "b", 2, "open"), (0, "b", 2, "closed")]
        add([("r", "c", 3)])
        assert rows_until(4)[2:] == [(1, "c", 1, "open"), (1, "c", 1, "closed")]
    finally:
        q.stop()
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
