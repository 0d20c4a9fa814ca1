"""Rule engine against results worked out by hand."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sysloom.functions import packs
from sysloom.operators import reports, rules

IP = {"8.8.8.8": 134744072, "127.0.0.1": 16777343, "0.0.0.0": 0, "104.16.3.7": 117641320, "68.16.0.0": 4164}


def verdict(df):
    return rules.verdicts(df).collect()[0]


def test_malicious_run(events):
    v = events([("OPENAT", "node", "/etc/shadow"), ("OPENAT", "node", "/root/.ssh/id_rsa"), ("OPENAT", "node", "/root/.npmrc"),
                ("EXECVE", "sh", "whoami"), ("EXECVE", "sh", "/usr/bin/curl")])
    row = verdict(v)
    assert (row.threat_score, row.risk_level, row.finding_count) == (85, "MALICIOUS", 4)
    assert (row.execve_count, row.openat_count, row.events_analyzed) == (2, 3, 5)
    listed = reports.order_findings(rules.findings(v)).collect()
    assert [r.key for r in listed] == ["/etc/shadow", "/.ssh/id_rsa", "curl", "whoami"]
    assert listed[2].evidence == "execve: sh → /usr/bin/curl (PID=104)"
    assert listed[0].evidence == "openat: node → /etc/shadow (PID=100)"


@pytest.mark.parametrize("rule", packs.EXEC_RULES, ids=lambda r: r.pattern)
def test_exec_rules_by_file_and_by_process(events, rule):
    by_file = verdict(events([("EXECVE", "sh", f"/usr/bin/{rule.pattern}")]))
    by_process = verdict(events([("EXECVE", f" {rule.pattern}\n", "/bin/x")]))
    assert by_file.threat_score == by_process.threat_score == rule.points


@pytest.mark.parametrize("rule", packs.FILE_RULES, ids=lambda r: r.pattern)
def test_file_rules(events, rule):
    assert verdict(events([("OPENAT", "sh", f" /x{rule.pattern} ")])).threat_score == rule.points


def test_near_misses(events):
    v = events([("EXECVE", "node", "/usr/bin/python3"), ("EXECVE", "node", "/usr/bin/id/"), ("OPENAT", "npm install x", "/r/.npmrc"),
                ("OPENAT", " node ", "/r/.npmrc"), ("OPENAT", "sh", "/app/node_modules/b/.npmrc"), ("UNLINK", "sh", "  "),
                ("OPENAT", "sh", "/proc/self/maps"), ("WRITE", "curl", ""), ("OTHER", "nc", "/etc/shadow")])
    row = verdict(v)
    assert (row.threat_score, row.risk_level, row.finding_count, row.events_analyzed, row.unlink_count) == (0, "SAFE", 0, 9, 1)


def test_exempt_process_still_meets_other_rules(events):
    assert verdict(events([("OPENAT", "node", "/x/.npmrc/etc/passwd")])).threat_score == 5


def test_one_event_two_rules_and_first_evidence(events):
    v = events([("EXECVE", "curl", "/usr/bin/nc"), ("EXECVE", "sh", "/bin/curl"), ("EXECVE", "curl", "/bin/curl")])
    found = {r.key: r for r in rules.findings(v).collect()}
    assert set(found) == {"curl", "nc"}
    assert found["curl"].evidence == "execve: curl → /usr/bin/nc (PID=100)"
    assert verdict(v).threat_score == 45


@pytest.mark.parametrize("n,points", [(11, 0), (12, 12), (15, 18), (16, 20), (40, 20)])
def test_burst(events, n, points):
    row = verdict(events([("EXECVE", "node", "/x")] * n))
    assert (row.threat_score, row.finding_count) == (points, int(points > 0))


def test_burst_evidence(events):
    v = events([("EXECVE", p, "/x") for p in ["zeta", "node", "alpha", " alpha "] * 3])
    assert rules.exec_burst(v).first().processes == "alpha, zeta"
    assert rules.exec_burst(events([("EXECVE", "node", "/x")] * 12)).first().processes == "none identified"


def test_connections(events):
    make = lambda ip, port: ("CONNECT", "node", "", {"connect_ip": IP[ip], "connect_port": port})
    v = events([make("127.0.0.1", 1), make("0.0.0.0", 1), make("104.16.3.7", 443), make("8.8.8.8", 53), make("8.8.8.8", 53),
                make("8.8.8.8", 80), make("68.16.0.0", 80)])
    assert {(r.ip, r.connect_port) for r in rules.connection_findings(v).collect()} == {("8.8.8.8", 53), ("8.8.8.8", 80), ("68.16.0.0", 80)}
    assert (verdict(v).threat_score, verdict(v).connect_count) == (60, 7)


def test_unlink_once_per_file(events):
    v = events([("UNLINK", " sh", " /a "), ("UNLINK", "x", "/a"), ("UNLINK", "x", "/b")])
    assert verdict(v).threat_score == 30
    assert {r.evidence for r in rules.findings(v).collect()} == {"unlinkat:  sh deleted /a (PID=100)", "unlinkat: x deleted /b (PID=102)"}


@pytest.mark.parametrize("score,band", [(10, "SAFE"), (11, "SAFE"), (24, "SAFE"), (25, "SUSPICIOUS"), (59, "SUSPICIOUS"), (60, "MALICIOUS")])
def test_bands(spark, score, band):
    from sysloom.functions import columns as fx
    row = spark.range(1).selectExpr(f"{score} AS s").select(fx.risk_band("s").alias("b"), fx.triage_route("s").alias("r")).first()
    assert row.b == band
    assert row.r == ("clearly safe" if score <= 10 else "llm" if score <= 59 else "clearly malicious")


def test_score_is_capped(events):
    v = events([("OPENAT", "sh", "/x" + r.pattern) for r in packs.FILE_RULES])
    assert verdict(v).threat_score == 100


def test_own_pack_from_a_table(spark, events):
    table = spark.createDataFrame([("evil", 60, "HIGH", "recon", "T1033", "Ran evil")],
                                  "pattern string, points int, severity string, category string, mitre_id string, description string")
    pack = packs.rules_from_table(table)
    row = rules.verdicts(events([("EXECVE", "sh", "/bin/evil"), ("EXECVE", "sh", "curl")]), exec_pack=pack).first()
    assert row.threat_score == 60


TYPES = ("EXECVE", "OPENAT", "CONNECT", "WRITE", "UNLINK", "ODD")
ROWS = st.lists(st.tuples(st.sampled_from(TYPES), st.sampled_from(("sh", "curl", "node", "nc ")),
                          st.sampled_from(("/etc/passwd", "/bin/id", "", "/app/package.json", "/r/.npmrc"))), min_size=1, max_size=25)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=ROWS, seed=st.integers(0, 99))
def test_order_of_rows_and_repeats_do_not_matter(events, rows, seed):
    numbered = [(*r, {"seq": i, "pid": i}) for i, r in enumerate(rows)]
    plain = events(numbered)
    shuffled = list(numbered)
    random.Random(seed).shuffle(shuffled)
    mixed = events(shuffled).repartition(3)
    cols = ("kind", "key", "points", "evidence", "order_key")
    listed = lambda df: sorted(map(tuple, rules.findings(df).select(*cols).collect()))
    assert listed(plain) == listed(mixed)
    assert verdict(plain) == verdict(mixed)
    assert 0 <= verdict(plain).threat_score <= 100
    # a repeated event changes counts, never the points of single findings
    twice = events(numbered + [(*rows[0], {"seq": 999, "pid": 7})])
    no_burst = lambda df: [r for r in listed(df) if r[0] != "burst"]
    assert no_burst(twice) == no_burst(plain)
    assert verdict(twice).events_analyzed == len(rows) + 1
