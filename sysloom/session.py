"""Session settings and written tables that cut lineage."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

SCRATCH = "sysloom_scratch"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings the operators rely on."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    A session without that setting uses a folder in its warehouse.  On a cluster that must be a
    shared one as well: a path on the driver's machine is refused unless the master is local.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints"
        on_one_machine = spark.sparkContext.master.split("[")[0] == "local"
        if not on_one_machine and (shared.startswith("file:") or shared.startswith("/")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return shared.rstrip("/") + "/" + SCRATCH


def drop_shuffles(spark: SparkSession) -> None:
    """Delete the shuffle files that no live DataFrame needs, after a large step has been written.

    Spark's cleaner removes them once the driver has collected its garbage, which a driver with
    much free memory may not do for a long time.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut_lineage(df: DataFrame, buckets: tuple[int, str] | None = None, **options: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    The table survives the loss of executors and each row is computed exactly once.
    ``release`` drops it as soon as no later step reads it.  With ``buckets`` (number, column) it is
    bucketed, so that grouping by the column needs no shuffle; ``options`` go to the writer.
    """
    spark = df.sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {SCRATCH} LOCATION '{scratch_folder(spark)}'")
    name = f"{SCRATCH}.t_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").options(**options)
    (writer.bucketBy(*buckets) if buckets else writer).saveAsTable(name)
    table = spark.table(name)
    table._scratch_name = name
    return table


def release(*tables: DataFrame) -> None:
    """Drop tables made by ``cut_lineage`` together with their files."""
    for table in tables:
        table.sparkSession.sql(f"DROP TABLE IF EXISTS {table._scratch_name}")


def release_all(spark: SparkSession) -> None:
    """Drop every table that ``cut_lineage`` left in this session."""
    spark.sql(f"DROP DATABASE IF EXISTS {SCRATCH} CASCADE")
