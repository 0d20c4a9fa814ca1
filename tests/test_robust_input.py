"""Damaged archives, lockfiles of other shapes, repeated answers and rules."""

import io
import random
import tarfile

import pytest

from sysloom.functions import packs
from sysloom.operators import dependencies, narrative, registry, rules
from sysloom.sources import packages


def archive(rnd, members=6):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        for k in range(members):
            data = bytes(rnd.randrange(32, 127) for _ in range(rnd.randrange(500, 3000)))
            info = tarfile.TarInfo(f"package/m{k}.js")
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    return out.getvalue()


def test_damaged_archives_are_rejected_not_fatal():
    rnd = random.Random(1)
    for k in range(60):
        data = bytearray(archive(rnd))
        if k % 2:
            data = data[:rnd.randrange(20, len(data) - 20)]
        else:
            at = rnd.randrange(20, len(data) - 20)
            data[at:at + 4] = bytes(x ^ 0x5A for x in data[at:at + 4])
        rows = list(packages._unpacked("p", bytes(data)))
        good = [r for r in rows if r[3] is None]
        assert len(good) == 6 or any(r[3] for r in rows)
    assert [r[3] for r in packages._unpacked("p", archive(rnd))] == [None] * 6
    assert [r[3] for r in packages._unpacked("p", b"")] == ["unreadable: ReadError"]


def test_links_and_rejects_are_listed(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tgz", "w:gz") as tar:
        info = tarfile.TarInfo("package/index.js")
        info.type, info.linkname = tarfile.SYMTYPE, "/etc/passwd"
        tar.addfile(info)
    (tmp_path / "b.tgz").write_bytes(b"no archive")
    assert packages.read_package_tarballs(spark, f"{tmp_path}/*.tgz").count() == 0
    rows = packages.rejected_tarballs(spark, f"{tmp_path}/*.tgz").collect()
    assert sorted((r.package, r.problem) for r in rows) == [("a", "link"), ("b", "unreadable: ReadError")]


def test_pnpm_keys_of_other_shapes(spark):
    long = "/" + "x" * 20_000 + "@1.0.0"
    texts = {
        "comments": "packages:\n" + "  # note\n\n" * 5000 + "  /a@1.0.0:\n    dev: true\n",
        "quoted": f"packages:\n\n  '{long}':\n    dev: true\n  '/it''s@2.0.0': {{dev: true}}\n",
        "explicit": "packages:\n  ? /very-long@1.0.0\n  : dev: true\n  /b@2.0.0: {dev: true}\nother:\n  /c@1.0.0: 1\n",
        "flow": "packages: {/a@1.0.0: {dev: true}}\n", "none": "packages: {}\n"}
    locks = spark.createDataFrame(list(texts.items()), "project string, content string")
    found = {}
    for r in dependencies.pnpm_targets(locks).collect():
        found.setdefault(r.project, set()).add((r.name[:9], r.version))
    assert found == {"comments": {("a", "1.0.0")}, "quoted": {("x" * 9, "1.0.0"), ("it's", "2.0.0")}, "explicit": {("very-long", "1.0.0"), ("b", "2.0.0")}}
    assert [tuple(r) for r in dependencies.rejected_lockfiles(locks, "pnpm").collect()] == [("flow", "not in block style")]
    bad = spark.createDataFrame([("p", "{"), ("q", '{"lockfileVersion": 2}')], "project string, content string")
    assert [r.project for r in dependencies.rejected_lockfiles(bad, "npm").collect()] == ["p"]


def test_the_last_of_repeated_answers_counts(spark):
    answers = spark.createDataFrame([("r1", '{"threat_score": 20}', 2), ("r1", '{"threat_score": 50}', 1), ("r2", "x", 1)], "detonation_id string, response string, n int")
    assert {(r.detonation_id, r.response) for r in narrative.one_answer(answers, "n").collect()} == {("r1", '{"threat_score": 20}'), ("r2", "x")}
    assert narrative.one_answer(answers).count() == 2


def test_first_rule_of_a_pattern_counts(events):
    rule = packs.EXEC_RULES[0]
    pack = (rule._replace(points=7), rule._replace(points=50), *packs.EXEC_RULES[1:])
    assert [r.points for r in packs.first_per_pattern(pack)][0] == 7
    table = events([("EXECVE", rule.pattern, f"/bin/{rule.pattern}")])
    assert rules.verdicts(table, exec_pack=pack).count() == 1
    single = rules.findings(table, exec_pack=packs.first_per_pattern(pack)).count()
    assert rules.findings(table, exec_pack=pack).count() == single


def test_names_beyond_reach_make_no_variants(spark):
    names = spark.createDataFrame([("x" * 214,), ("expresss",)], "package_name string")
    assert [(r.package_name, r.nearest.target) for r in registry.nearest_in_table(names, spark.createDataFrame([("express",), ("react",), (None,)], "name string")).collect()] == [("expresss", "express")]


@pytest.mark.parametrize("rule_type", [packs.EXEC_RULES, packs.FILE_RULES])
def test_shipped_packs_have_no_repeated_pattern(rule_type):
    assert packs.first_per_pattern(rule_type) == tuple(rule_type)
