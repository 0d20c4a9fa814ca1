"""Report sink and source, run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..schemas import REPORT_SCHEMA


def write_reports(documents: DataFrame, path: str, batch_id: int = 0) -> None:
    """Write report documents as JSON lines under ``batch_id=<n>``.

    A replayed batch overwrites its own folder, so the write is idempotent; a
    later batch's report of the same run replaces the earlier one on reading.
    """
    documents.write.mode("overwrite").json(f"{path}/batch_id={batch_id}")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Latest report of each run (all its parts)."""
    rows = spark.read.schema(StructType([*REPORT_SCHEMA, StructField("batch_id", LongType())])).json(path)
    newest = rows.groupBy("report_id").agg(F.max("batch_id").alias("batch_id"))
    return rows.join(newest, ["report_id", "batch_id"]).select(*REPORT_SCHEMA.fieldNames())


def read_report_files(spark: SparkSession, path: str) -> DataFrame:
    """A folder with one JSON file per report (the id is the file name).  Only
    files directly in it are read, damaged ones are left out, and missing or
    mistyped fields take the zero value of their type."""
    schema = "_bad string, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in REPORT_SCHEMA)
    files = spark.read.text(f"{path}/*.json", wholetext=True)
    doc = F.from_json("value", schema, {"columnNameOfCorruptRecord": "_bad"})
    name = F.regexp_replace(F.substring_index(F.input_file_name(), "/", -1), r"\.json$", "")
    rows = files.select(name.alias("report_id"), F.col("value"), doc.alias("d"))
    # a mistyped field flags the document as bad too: a real object still counts
    readable = F.try_parse_json("value").isNotNull() & F.ltrim("value").startswith("{")
    zero = {"string": F.lit(""), "bigint": F.lit(0)}
    def value(field):
        c = F.col(f"d.{field.name}")
        kind = field.dataType.simpleString()
        return F.coalesce(c, zero[kind] if kind in zero else F.array()).cast(field.dataType).alias(field.name)
    return rows.filter(readable).select("report_id", *[value(f) for f in REPORT_SCHEMA if f.name != "report_id"])


def read_run_logs(spark: SparkSession, path: str) -> DataFrame:
    """One log text per run; the file name without suffix is the run."""
    files = spark.read.text(path, wholetext=True)
    name = F.regexp_replace(F.substring_index(F.input_file_name(), "/", -1), r"\.[^.]*$", "")
    return files.select(name.alias("detonation_id"), F.col("value").alias("log"))
