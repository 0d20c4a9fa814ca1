"""Lockfiles of all dialects as target tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dependencies


def dialect(path: Column) -> Column:
    """pnpm lockfile, bare manifest, or (everything else) npm lockfile."""
    return (F.when(path.endswith("pnpm-lock.yaml"), "pnpm")
            .when(path.endswith("package.json") & ~path.endswith("package-lock.json"), "manifest")
            .otherwise("npm"))


def read_lockfiles(spark: SparkSession, glob: str) -> DataFrame:
    """(project, dialect, content); the path is the project."""
    files = spark.read.text(glob, wholetext=True).select(F.input_file_name().alias("project"), F.col("value").alias("content"))
    return files.withColumn("dialect", dialect(F.col("project")))


def lockfile_targets(locks: DataFrame) -> DataFrame:
    """Distinct targets of each lockfile, whatever its dialect."""
    of = lambda kind: locks.filter(F.col("dialect") == kind)
    rows = (dependencies.npm_lock_targets(of("npm")).unionByName(dependencies.npm_v1_targets(of("npm")))
            .unionByName(dependencies.pnpm_targets(of("pnpm"))).unionByName(dependencies.manifest_targets(of("manifest"))))
    return dependencies.distinct_targets(rows)
