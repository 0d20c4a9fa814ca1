"""Lockfile analytics.  A lockfile is one (project, content) row; its entries are
exploded from it, so the parsing is row-local."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as fx

NPM_SCHEMA = (
    "lockfileVersion int, packages map<string,struct<name:string,version:string>>, "
    "dependencies map<string,struct<version:string>>, _bad string")
BARE_SCHEMA = "dependencies map<string,string>, devDependencies map<string,string>, _bad string"


def _parse(locks: DataFrame, schema: str) -> DataFrame:
    """Fields of the files; unreadable files give no targets."""
    return fx.parse_json(locks, "content", schema, ["project"]).filter(F.col("_bad").isNull())


def npm_lock_targets(locks: DataFrame) -> DataFrame:
    """Entries of the ``packages`` map (lockfile version 2 and later)."""
    entries = _parse(locks, NPM_SCHEMA).filter(F.col("lockfileVersion") >= 2).select(
        "project", F.explode("packages").alias("lock_key", "entry")).filter(F.col("lock_key") != "")
    marker = "node_modules/"
    name = F.coalesce(F.nullif("entry.name", F.lit("")), F.substring_index("lock_key", marker, -1))
    name = F.when(name.startswith(marker), F.substr(name, F.lit(len(marker) + 1))).otherwise(name)
    return entries.select("project", "lock_key", name.alias("name"), F.coalesce("entry.version", F.lit("")).alias("version"))


def npm_v1_targets(locks: DataFrame) -> DataFrame:
    """Top-level ``dependencies`` of older lockfiles."""
    old = _parse(locks, NPM_SCHEMA).filter(F.coalesce("lockfileVersion", F.lit(0)) < 2)
    return old.select("project", F.explode("dependencies").alias("name", "entry")).select(
        "project", F.col("name").alias("lock_key"), "name", F.coalesce("entry.version", F.lit("")).alias("version"))


_PNPM_BLOCK = r"(?s)(?:^|\n)packages:[ \t]*\r?\n(.*?)(?=\n[^\s#]|\z)"


def pnpm_keys(locks: DataFrame) -> DataFrame:
    """(project, lock_key): keys of the top-level ``packages:`` block of pnpm YAML texts.

    Block style with plain, quoted and explicit (``? key``) keys.  No pattern repeats a group,
    so texts and keys of any length are matched without recursion.
    """
    lines = fx.split_lines("block")
    blocks = locks.select("project", F.regexp_extract("content", _PNPM_BLOCK, 1).alias("block")).select("project", lines.alias("lines"))
    text = F.filter("lines", lambda x: (F.ltrim(x) != "") & ~F.ltrim(x).startswith("#"))
    blocks = blocks.select("project", text.alias("lines"))
    width = lambda x: F.length(x) - F.length(F.ltrim(x))
    blocks = blocks.select("project", "lines", width(F.get("lines", F.lit(0))).alias("indent"))
    rows = blocks.select("project", "indent", F.explode("lines").alias("line"))
    # a key is indented exactly like the first one; a line from a colon on is an explicit key's value
    rows = rows.filter((width(F.col("line")) == F.col("indent")) & ~F.ltrim("line").startswith(":"))
    bare = F.ltrim("line")
    entry = F.when(bare.startswith("? "), F.concat(F.rtrim(F.ltrim(F.substr(bare, F.lit(3)))), F.lit(":"))).otherwise(bare)
    keyed = rows.select("project", entry.alias("entry"))
    key = F.coalesce(
        F.nullif(F.replace(F.regexp_extract("entry", r"^'(.*?)'\s*:(?:\s|$)", 1), F.lit("''"), F.lit("'")), F.lit("")),
        F.nullif(F.regexp_extract("entry", r'^"([^"]*)"\s*:', 1), F.lit("")),
        F.regexp_extract("entry", r"^([^\s#'\"].*?)\s*:(?:\s|$)", 1))
    return keyed.select("project", key.alias("lock_key")).filter(F.col("lock_key") != "")


def rejected_lockfiles(locks: DataFrame, dialect: str) -> DataFrame:
    """(project, problem) of the files that give no target although they may have some.

    ``dialect`` is npm or manifest (JSON that cannot be read) or pnpm (a ``packages``
    value that is not written in block style).
    """
    if dialect == "pnpm":
        inline = F.regexp_extract("content", r"(?:^|\n)packages:[ \t]*([^\s#][^\n]*)", 1)
        return locks.filter((inline != "") & ~inline.rlike(r"^\{\s*\}\s*$")).select("project", F.lit("not in block style").alias("problem"))
    schema = {"npm": NPM_SCHEMA, "manifest": BARE_SCHEMA}[dialect]
    bad = fx.parse_json(locks, "content", schema, ["project"]).filter(F.col("_bad").isNotNull())
    return bad.select("project", F.lit("not readable").alias("problem"))


def split_pnpm_key(key: Column) -> tuple[Column, Column]:
    """pnpm key to (name, version): no leading slash, no peer suffix, last @ splits."""
    bare = F.when(key.startswith("/"), F.substr(key, F.lit(2))).otherwise(key)
    return fx.split_spec(F.substring_index(bare, "(", 1))


def pnpm_targets(locks: DataFrame) -> DataFrame:
    keys = pnpm_keys(locks)
    name, version = split_pnpm_key(F.col("lock_key"))
    return keys.select("project", "lock_key", name.alias("name"), version.alias("version")).filter(F.col("name") != "")


def manifest_targets(manifests: DataFrame) -> DataFrame:
    """Dependencies of a bare package.json; a development entry wins over a plain one."""
    doc = _parse(manifests, BARE_SCHEMA)
    plain = F.coalesce("dependencies", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    dev = F.coalesce("devDependencies", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    merged = F.map_concat(F.map_filter(plain, lambda k, v: ~F.map_contains_key(dev, k)), dev)
    return doc.select("project", F.explode(merged).alias("name", "version")).select(
        "project", F.col("name").alias("lock_key"), "name", "version")


def distinct_targets(targets: DataFrame, per_version: bool = False) -> DataFrame:
    """One target per name and project: the entry with the greatest key wins.
    ``per_version`` keeps every version."""
    if per_version:
        return targets.select("project", "name", "version").distinct()
    return targets.groupBy("project", "name").agg(F.max_by("version", "lock_key").alias("version"))


def limit_targets(targets: DataFrame, n: int) -> DataFrame:
    """The first n targets of a project by name (n <= 0: all), with the project's total."""
    total = targets.groupBy("project").agg(F.count("*").alias("total"))
    if n > 0:
        by_name = Window.partitionBy("project").orderBy("name")
        targets = targets.withColumn("_n", F.row_number().over(by_name)).filter(F.col("_n") <= n).drop("_n")
    return targets.join(total, "project")


def batch_outcomes(targets: DataFrame, runs: DataFrame) -> DataFrame:
    """Targets of a project by the outcome of their package's latest run."""
    latest = runs.groupBy("package_name").agg(
        F.max_by("success", F.struct("started_at", "detonation_id")).alias("success"))
    joined = targets.join(latest, "package_name", "left")
    return joined.groupBy("project").agg(
        F.count("*").alias("targets"), F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"),
        F.count_if(F.col("success").isNull()).alias("not_run"))


def dependency_risk(targets: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Risk of a project through its dependencies.  Verdicts are reduced to the
    worst per package before the join: no (target, run) pairs are formed."""
    worst = verdicts.groupBy("package_name").agg(F.max("threat_score").alias("score"))
    joined = targets.join(worst, "package_name", "left").withColumn("risk", F.when(
        F.col("score").isNotNull(), fx.risk_band("score")))
    count = lambda band: F.count_if(F.col("risk") == band).alias(band.lower())
    return joined.groupBy("project").agg(
        F.count("*").alias("targets"), F.count("score").alias("assessed"), F.max("score").alias("worst_score"),
        count("MALICIOUS"), count("SUSPICIOUS"), count("SAFE"))
