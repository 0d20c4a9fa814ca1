"""Static scan of package sources: (package, path, content) rows in, findings out.

The scan is row-local and has no shuffle.  A rule's literal needle is tested on
the bytes of the whole text first; only texts that hold one are split into lines, once
for all rules, and a regex runs on the lines that hold its needle.  A text's hits are an
array of (rule, line), so no text is copied per rule.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as fx
from ..functions import packs

PREVIEW_CHARS = 80
# fixed values: static score per severity
SCORES = {"CRITICAL": 25, "HIGH": 15, "MEDIUM": 5}
OTHER_SCORE = 2


def filter_scannable(files: DataFrame) -> DataFrame:
    """Source files by their last suffix, outside node_modules folders."""
    name = fx.basename("path")
    # a leading dot is part of the name, not a suffix
    suffix = F.regexp_extract(name, r"[^.].*?(\.[^.]+)$", 1)
    vendored = F.array_contains(F.split("path", "/"), "node_modules")
    return files.filter(suffix.isin(*packs.SCANNABLE_SUFFIXES) & ~vendored)


def _unicode(regex: str) -> str:
    """Character classes cover all of Unicode, as they do in the rules' dialect."""
    return "(?U)" + regex


def scan_rule_pack(files: DataFrame, rules: Sequence[packs.CodeRule], ids: Sequence[str] = ("package", "path"),
                   content: str = "content") -> DataFrame:
    """First matching line per (text, rule): rule number, line number, line preview."""
    rules = packs.checked(rules)

    def regex(rule: packs.CodeRule) -> str:
        return fx.sql_text(_unicode(rule.regex))

    def holds(rule: packs.CodeRule, text: str) -> str:
        return f"contains({text}, {fx.sql_text(rule.needle)})"

    def candidate(rule: packs.CodeRule) -> str:
        return holds(rule, content) if rule.needle else f"{content} RLIKE {regex(rule)}"

    def hit(number: int, rule: packs.CodeRule) -> str:
        """The rule's first line as an array of at most one hit."""
        needle = f"{holds(rule, 'x')} AND " if rule.needle else ""
        lines = f"transform(_lines, x -> {needle}x RLIKE {regex(rule)})"
        place = f"CASE WHEN {holds(rule, content) if rule.needle else 'true'} THEN array_position({lines}, true) END"
        return f"transform(filter(array({place}), n -> n > 0), n -> struct({number} AS rule_no, n AS line_no, element_at(_lines, cast(n AS int)) AS line))"

    some = F.expr(" OR ".join(candidate(r) for r in rules) or "false")
    split = files.select(*ids, content, fx.once(F.when(some, fx.split_lines(content))).alias("_lines")).filter(F.col("_lines").isNotNull())
    hits = F.expr(f"flatten(array({', '.join(hit(i, r) for i, r in enumerate(rules, 1))}))")
    found = split.select(*ids, F.explode(hits).alias("_hit"))
    return found.select(*ids, "_hit.rule_no", F.col("_hit.line_no").cast("long").alias("line_no"),
                        F.substring(fx.strip_ws("_hit.line"), 1, PREVIEW_CHARS).alias("line"))


def scan_patterns(files: DataFrame, rules: Sequence[packs.CodeRule] = packs.CODE_RULES) -> DataFrame:
    """Findings of a source pack with severity, category and technique."""
    found = scan_rule_pack(filter_scannable(files), rules)
    table = packs.pack_table(files.sparkSession, rules, "code").withColumnRenamed("ordinal", "rule_no")
    evidence = F.concat("path", F.lit(":"), F.col("line_no").cast("string"), F.lit(" → "), "line")
    return found.join(table, "rule_no").select(
        "package", "path", "rule_no", "line_no", "severity", "category", F.col("rule_text").alias("description"),
        evidence.alias("evidence"), "mitre_id", "mitre_name")


def lifecycle_hooks(files: DataFrame) -> DataFrame:
    """Install-time scripts of the root package.json; unreadable JSON gives none."""
    manifests = files.filter(F.col("path") == "package.json")
    docs = fx.parse_json(manifests, "content", "scripts map<string,string>, _bad string", ["package", "path"])
    scripts = docs.filter(F.col("_bad").isNull()).select("package", "path", F.explode("scripts").alias("hook", "script"))
    mitre = "T1204.002"
    return scripts.filter(F.col("hook").isin(*packs.LIFECYCLE_HOOKS)).select(
        "package", "path", F.lit(0).alias("rule_no"), F.lit(0).cast("long").alias("line_no"), F.lit("HIGH").alias("severity"),
        F.lit("suspicious_activity").alias("category"),
        F.concat(F.lit("Runs a '"), "hook", F.lit("' script: "), "script").alias("description"),
        F.concat(F.lit("scripts."), "hook", F.lit(' = "'), "script", F.lit('"')).alias("evidence"),
        F.lit(mitre).alias("mitre_id"), F.lit(packs.MITRE_NAMES[mitre]).alias("mitre_name"), "hook")


def scan_findings(files: DataFrame, rules: Sequence[packs.CodeRule] = packs.CODE_RULES) -> DataFrame:
    """Hooks and pattern findings; (severity_rank, path, rule_no) is the listing order."""
    found = lifecycle_hooks(files).drop("hook").unionByName(scan_patterns(files, rules))
    return found.withColumn("severity_rank", fx.severity_rank("severity"))


def static_score(found: DataFrame) -> DataFrame:
    points = reduce(lambda acc, kv: acc.when(F.col("severity") == kv[0], kv[1]), SCORES.items(), F).otherwise(OTHER_SCORE)
    return found.groupBy("package").agg(F.count("*").alias("findings"), F.least(F.sum(points), F.lit(100)).alias("static_score"))
