"""Syscall telemetry: topic or directory in, decoded events out, and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions import columns as fx
from ..schemas import EVENT_FIELDS, OPTIONAL_EVENT_FIELDS, REQUIRED_EVENT_FIELDS, SYSCALL_SCHEMA

DEFAULT_TOPIC = "syscall-telemetry"
MAX_OFFSETS_PER_TRIGGER = 1_000_000


def read_syscall_stream(spark: SparkSession, brokers: str | None = None, topic: str = DEFAULT_TOPIC,
                        starting: str = "latest", directory: str | None = None,
                        max_per_trigger: int = MAX_OFFSETS_PER_TRIGGER, max_files_per_trigger: int = 1_000) -> DataFrame:
    """Live raw messages (seq, value, arrived_at): from Kafka, or from a directory of JSON lines."""
    if directory is not None:
        raw = spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger).text(directory)
        return raw.select(F.lit(None).cast("long").alias("seq"), "value", _written_at())
    raw = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", brokers).option("subscribe", topic)
           .option("startingOffsets", starting).option("maxOffsetsPerTrigger", max_per_trigger).load())
    return _kafka_values(raw)


def read_syscall_history(spark: SparkSession, brokers: str | None = None, topic: str = DEFAULT_TOPIC,
                         directory: str | None = None) -> DataFrame:
    """All messages of the topic so far, bounded; or a directory of JSON lines."""
    if directory is not None:
        return spark.read.text(directory).select(F.lit(None).cast("long").alias("seq"), "value", _written_at())
    raw = (spark.read.format("kafka").option("kafka.bootstrap.servers", brokers).option("subscribe", topic)
           .option("startingOffsets", "earliest").option("endingOffsets", "latest").load())
    return _kafka_values(raw)


def _kafka_values(raw: DataFrame) -> DataFrame:
    # arrival order is only defined inside a partition; a run has one key and
    # therefore one partition, so its offsets order its events
    return raw.select(F.col("offset").alias("seq"), F.col("value").cast("string").alias("value"), F.col("timestamp").alias("arrived_at"))


def _written_at() -> Column:
    """A time of arrival that does not change when the file is read again."""
    return F.col("_metadata.file_modification_time").alias("arrived_at")


_TEXT_SCHEMA = StructType([StructField(n, StringType()) for n in EVENT_FIELDS] + [StructField("_bad", StringType())])


def decode_syscalls(raw: DataFrame, keep: Sequence[str] = ("seq",)) -> tuple[DataFrame, DataFrame]:
    """Messages to (events, rejects).

    Integers may come as numbers or as text.  A message that is no JSON object,
    lacks a required field or holds no number where one is due is rejected with
    a reason; absent optional fields take their defaults.
    """
    parsed = fx.parse_json(raw, "value", _TEXT_SCHEMA, [*keep, "value"])

    def field(name: str) -> Column:
        is_number = isinstance(SYSCALL_SCHEMA[name].dataType, LongType)
        return F.col(name).try_cast("long") if is_number else F.col(name)

    numbers = [n for n in EVENT_FIELDS if isinstance(SYSCALL_SCHEMA[n].dataType, LongType)]
    missing = " OR ".join(f"{n} IS NULL" for n in REQUIRED_EVENT_FIELDS)
    mistyped = " OR ".join(f"({n} IS NOT NULL AND try_cast({n} AS BIGINT) IS NULL)" for n in numbers)
    reason = F.expr(f"""CASE WHEN _bad IS NOT NULL OR NOT startswith(ltrim(value), '{{') THEN 'malformed'
        WHEN {missing} THEN 'missing field' WHEN {mistyped} THEN 'not a number' END""")
    judged = parsed.withColumn("reason", reason)
    columns = [F.coalesce(field(n), F.lit(OPTIONAL_EVENT_FIELDS[n]).cast(SYSCALL_SCHEMA[n].dataType)).alias(n)
               if n in OPTIONAL_EVENT_FIELDS else field(n).alias(n) for n in EVENT_FIELDS]
    events = judged.filter(F.col("reason").isNull()).select(*keep, *columns)
    rejects = judged.filter(F.col("reason").isNotNull()).select(*keep, "value", "reason")
    return events, rejects


def with_arrival_order(events: DataFrame) -> DataFrame:
    """Fill ``seq`` from the kernel time where the source gives no offset, and
    parse the capture time (UTC unless it names a zone)."""
    return events.withColumn("seq", F.coalesce("seq", "timestamp_ns")).withColumn(
        "captured_at", F.try_to_timestamp("captured_at"))


def to_wire(events: DataFrame) -> DataFrame:
    """Events as (key, value) messages: key = run, value = JSON of all fields."""
    return events.select(F.col("detonation_id").alias("key"), F.to_json(F.struct(*EVENT_FIELDS)).alias("value"))


def publish_syscalls(events: DataFrame, brokers: str | None = None, topic: str = DEFAULT_TOPIC, directory: str | None = None) -> None:
    """Write messages to Kafka (acks=1), or append them to a directory of JSON lines."""
    wire = to_wire(events)
    if directory is not None:
        wire.select("value").write.mode("append").text(directory)
        return
    (wire.write.format("kafka").option("kafka.bootstrap.servers", brokers).option("topic", topic)
     .option("kafka.acks", "1").save())
