"""Registry snapshots: one JSON document per package as the registry table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import REGISTRY_DOCUMENT_SCHEMA


def registry_table(documents: DataFrame) -> DataFrame:
    """Documents to the table the metadata operators read.  A publication time
    counts only if it names its zone."""
    latest = F.coalesce(F.try_element_at("dist-tags", F.lit("latest")), F.lit("unknown"))
    published = F.try_element_at("time", latest)
    zoned = published.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    names = F.transform(F.coalesce("maintainers", F.array().cast(REGISTRY_DOCUMENT_SCHEMA["maintainers"].dataType)), lambda m: m["name"])
    return documents.select(
        F.col("name").alias("registry_key"), F.col("name").alias("package_name"),
        F.when(F.col("error").isNotNull(), "error").otherwise("ok").alias("status"),
        latest.alias("latest_version"), F.greatest(size(F.map_keys("versions")), F.lit(0)).alias("version_count"),
        F.when(zoned, F.try_to_timestamp(published)).alias("latest_published"), "weekly_downloads", names.alias("maintainers"))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """A dump with one document per line; unreadable lines are left out, so
    their packages count as missing."""
    documents = spark.read.schema(REGISTRY_DOCUMENT_SCHEMA).json(path)
    return registry_table(documents.filter(F.col("name").isNotNull()))
