"""Digests, prompts, answers and registry merge."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sysloom.functions import packs
from sysloom.operators import narrative, registry, rules
from sysloom.operators.numbering import number_rows

VERDICT = ("detonation_id string, package_name string, threat_score long, risk_level string, recommendation string, "
           "analysis_method string, finding_count long")


def verdicts(spark, score):
    return spark.createDataFrame([("r", "p", score, "SUSPICIOUS", "rule advice", "rules", 3)], VERDICT)


def merge(spark, answer, score=30):
    text = answer if isinstance(answer, str) else json.dumps(answer)
    answers = spark.createDataFrame([("r", text)], "detonation_id string, response string")
    return narrative.merge_responses(verdicts(spark, score), answers).first()


def test_answer_defaults_and_invalid_findings(spark):
    row = merge(spark, {"findings": [{}, {"severity": "low"}, {"category": "odd"}, {"severity": "INFO", "category": "recon", "description": "d"}]})
    assert (row.threat_score, row.risk_level, row.recommendation) == (30, "SUSPICIOUS", "rule advice")
    assert [(f.severity, f.category, f.mitre_name) for f in row.model_findings] == [("MEDIUM", "suspicious_activity", ""), ("INFO", "recon", "")]
    assert row.finding_count == 2 and row.analysis_method == "hybrid (rules + LLM)"


@pytest.mark.parametrize("score,risk,expected", [(150, "malicious", (100, "MALICIOUS")), (-3, "safe", (0, "SAFE")), (40, "none", (40, "SUSPICIOUS"))])
def test_clamps(spark, score, risk, expected):
    row = merge(spark, {"threat_score": score, "risk_level": risk})
    assert (row.threat_score, row.risk_level) == expected


@pytest.mark.parametrize("text", ["sorry", "[1]", '{"threat_score": "x"}', '{"threat_score": 5', "```json\n{]\n```", ""])
def test_failed_answers_keep_the_rules(spark, text):
    row = merge(spark, text)
    assert (row.threat_score, row.finding_count, row.model_findings) == (30, 3, None)
    assert row.analysis_method == "rules only (LLM error: invalid answer)"


@pytest.mark.parametrize("text", ["```\n{B}\n```", "```json\n{B}", "  \n```json\n{B}\n ``` \n", "{B}"])
def test_fences(spark, text):
    assert merge(spark, text.replace("{B}", '{"threat_score": 12}')).threat_score == 12


@pytest.mark.parametrize("score", [10, 60])
def test_clear_verdicts_are_not_touched(spark, score):
    row = merge(spark, {"threat_score": 50}, score)
    assert (row.threat_score, row.analysis_method) == (score, "rules")


def test_chain(spark):
    chains = spark.createDataFrame([("r", '{"attack_chain": ["a", "b"]}')], "detonation_id string, response string")
    row = narrative.merge_attack_chains(verdicts(spark, 60), chains).first()
    assert (row.attack_chain, row.executive_summary, row.analysis_method) == (["a", "b"], "", "hybrid (rules + LLM attack chain)")
    assert narrative.merge_attack_chains(verdicts(spark, 59), chains).first().attack_chain == []


def test_digest_order_and_limits(events):
    rows = [("EXECVE", "sh", f"/b{i % 40}") for i in range(100)]
    lines = narrative.process_digest(events(rows)).orderBy("position").collect()
    assert [r.line for r in lines] == [f"  - sh executed: /b{i} (PID={100 + i})" for i in range(30)]
    opens = [("OPENAT", f"p{i}", f"/f{i % 60}") for i in range(120)] + [("OPENAT", "x", "/app/package.json"), ("OPENAT", "x", "/proc/self/maps")]
    files = narrative.file_digest(events(opens)).orderBy("position").collect()
    assert len(files) == 50 and files[0].unique_files == 61 and files[7].line == "  - p7 accessed: /f7"


def run_of(events, n):
    return events([("OPENAT", "sh", "/x/.ssh/id_rsa")] + [("CONNECT", "node", "", {"connect_ip": 16777343, "connect_port": i}) for i in range(n)])


def test_prompts(events):
    v = run_of(events, 3)
    text = narrative.analysis_prompts(v, rules.findings(v), rules.verdicts(v)).first().prompt
    assert text.index("Rule score: 25/100") < text.index("[CRITICAL] [T1552.004]") < text.index("node → 127.0.0.1:0") < text.index("127.0.0.1:2")
    assert "Processes started (0 in total)" in text and '"threat_score": 0-100' in text
    assert narrative.attack_chain_prompts(v, rules.findings(v), rules.verdicts(v)).count() == 0


def body(prompt):
    """Lines by section title."""
    out, title = {}, None
    for line in prompt.split("\n"):
        if line.startswith("# "):
            title = line
        elif title and line.startswith("  - "):
            out.setdefault(title, []).append(line)
    return out


def test_large_prompts_come_in_parts_of_fixed_size(events):
    v = run_of(events, 450)
    found, scored = rules.findings(v), rules.verdicts(v)
    whole = body(narrative.analysis_prompts(v, found, scored).first().prompt)
    parts = [r.prompt for r in narrative.analysis_prompts(v, found, scored, limit=100).orderBy("part_no").collect()]
    n = sum(map(len, whole.values()))
    assert len(parts) == -(-n // 100)
    joined = {}
    for k, part in enumerate(parts):
        assert f"Part {k + 1} of {len(parts)}" in part and part.startswith("Judge") and part.endswith(narrative.ANSWER_SHAPE)
        assert all(title in part for title in whole) and part.count("  (none)") == 1 and part.count("  (none beyond") == 1
        sections = body(part)
        assert sum(map(len, sections.values())) == (100 if k < len(parts) - 1 else n - 100 * k)
        for title, lines in sections.items():
            joined[title] = joined.get(title, []) + lines
    assert joined == whole


def test_empty_sections_and_unique_files(events):
    v = events([("OPENAT", "sh", "/x/.ssh/id_rsa"), ("OPENAT", "cat", "/x/.ssh/id_rsa"), ("OPENAT", "sh", "/data/a")])
    text = narrative.analysis_prompts(v, rules.findings(v), rules.verdicts(v)).first().prompt
    assert "install paths (2 unique)" in text and "  (none beyond npm and node)" in text and text.count("\n  (none)") == 2


def test_rows_are_numbered_exactly(spark):
    rnd = random.Random(1)
    # one key holds most rows, order values are dense in places, sparse in others, and repeat
    rows = [("hot", rnd.choice([i, i * 10**9, 7]), i) for i in range(3000)] + [(f"k{i % 50}", i, i) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, o long, u long")
    got = {(r.k, r.u): (r.row_no, r.rows_total, r.even) for r in number_rows(df, ["k"], ["o", "u"], {"even": F.col("u") % 2 == 0}).collect()}
    want = {}
    for key in {r[0] for r in rows}:
        mine = sorted((r[1], r[2]) for r in rows if r[0] == key)
        for no, (_, u) in enumerate(mine):
            want[key, u] = (no, len(mine), sum(x[1] % 2 == 0 for x in mine))
    assert got == want
    assert number_rows(df.limit(0), ["k"], ["o"]).count() == 0


def registry_table(spark, names):
    rows = [(n, n, "ok", "1.0.0", 1, None, 5000, ["a", "b"]) for n in names]
    return spark.createDataFrame(rows, "registry_key string, package_name string, status string, latest_version string, version_count long, "
                                       "latest_published timestamp, weekly_downloads long, maintainers array<string>")


def near(df):
    return {(r.package_name, r.target, r.distance) for r in df.collect()}


def test_typosquat(spark):
    names = ["lodash", "lodas", "LODASH", "Lodahs", "nuxt", "nxt", "expresss", "reactive", "vue", "vu", "v", "ab", "", "exprés"]
    got = near(registry.typosquat_candidates(registry_table(spark, names)))
    assert got == _short(names)
    assert {("lodas", "lodash", 1), ("Lodahs", "lodash", 2), ("nxt", "next", 1), ("v", "vue", 2)} <= got


def _short(names):
    """Brute force for the very short names."""
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    out = set()
    for n in names:
        if n in packs.POPULAR_PACKAGES:
            continue
        best = min((distance(n.lower(), p), p) for p in packs.POPULAR_PACKAGES if 0 < distance(n.lower(), p))
        if best[0] <= 2:
            out.add((n, best[1], best[0]))
    return out


def test_large_popular_list_gives_the_same(spark):
    names = ["lodash", "lodas", "Lodahs", "nxt", "expresss", "reactive", "vu", "v", "ab", "", "chalk2x", "xchal"]
    table = registry_table(spark, names)
    padded = packs.POPULAR_PACKAGES + tuple(f"unrelated-package-name-{i}" for i in range(200))
    listed = spark.createDataFrame([(p,) for p in padded], "name string")
    assert near(registry.typosquat_candidates(table, padded)) == near(registry.typosquat_candidates(table)) == _short(names)
    assert near(registry.typosquat_candidates(table, listed)) == _short(names)
    assert registry.typosquat_candidates(table, listed.limit(0)).count() == 0


def test_merge_metadata(spark):
    signals = spark.createDataFrame([("p", "HIGH"), ("p", "MEDIUM"), ("p", "LOW")], "registry_key string, severity string")
    scored = verdicts(spark, 56).withColumn("package_name", F.lit("p@1.2.3"))
    row = registry.merge_metadata(scored, signals).first()
    assert (row.threat_score, row.risk_level, row.finding_count) == (63, "SUSPICIOUS", 6)
    assert registry.merge_metadata(scored, signals, recompute_risk=True).first().risk_level == "MALICIOUS"
    assert registry.merge_metadata(verdicts(spark, 98).withColumn("package_name", F.lit("p")), signals).first().threat_score == 100
