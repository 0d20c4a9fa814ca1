"""Exact deduplication as a stream with state, in DataFrame functions alone.

A stream over the files of a table keeps a row of state per digest of the normalised text: how
many rows had it, the largest id, and the locator (file and row) of the content that bears it.
The state lies in RocksDB on the executors' disks with its changes in the checkpoint folder, never
expires, and is read back as a table.  Files that arrive later continue from the same checkpoint.

A digest seen more than once is a hit, and hits are checked in full: their texts are grouped by
all bytes, and a text that is not the one at the locator of its digest only collides with it.
Such digests are resolved by the texts themselves.  Texts without a hit are never shuffled:
the digests with hits are broadcast while there are at most ``BROADCAST_ROWS``, and joined by
shuffle beyond that, where adaptive execution splits a hot digest.

Rows: texts are equal when they agree after lower-casing A-Z; a null text counts as empty.  Of
equal texts the row with the largest id stays, of repeated rows of that id the last by file
and position; a null id is smaller than any other.  An empty table gives an empty result.
Columns of the table that are not named are not read, so their names cannot clash.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_folder

#: Bytes of input that one micro-batch takes.
BATCH_BYTES = 64 << 30
#: Digests with hits that are broadcast (a digest and a locator each); more are joined by shuffle.
BROADCAST_ROWS = 500_000
DIGEST_BYTES = 32
#: State on disk, without the megabytes that each partition would set aside for files to come.
_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def _located(docs: DataFrame, id_col: str, text_col: str, key_bytes: int, *more: Column) -> DataFrame:
    """(id, digest, key, file, at): the row's digest, the part of it that keys the state, and its place."""
    digest = F.unhex(F.sha2(normalised(F.col(text_col)).cast("binary"), 256))
    return docs.select(
        F.col(id_col).alias("id"), digest.alias("digest"), F.substring(digest, 1, key_bytes).alias("key"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"), *more)


def observe(
    spark: SparkSession, path: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text",
    batch_bytes: int = BATCH_BYTES, key_bytes: int = DIGEST_BYTES,
) -> None:
    """Bring the state in ``checkpoint`` up to date with the files of ``path``; files it has seen are not read again."""
    # as a pattern the path may also be a single file
    files = f"{path[:-1]}[{path[-1]}]"
    docs = spark.readStream.schema(spark.read.parquet(path).schema).option("maxBytesPerTrigger", batch_bytes).parquet(files)
    state = _located(docs, id_col, text_col, key_bytes).groupBy("key").agg(
        F.count("*").alias("n"), F.max(F.struct("id", "file", "at")).alias("top"))
    before = {key: spark.conf.get(key, None) for key in _STORE}
    for key, value in _STORE.items():
        spark.conf.set(key, value)
    try:
        stream = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    stream.awaitTermination()


def state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(key, n, keep_id, keep_file, keep_at): the retained state as a table."""
    kept = spark.read.format("statestore").load(checkpoint)
    # the value holds the aggregates in the order in which ``observe`` names them
    n, top = (f"value.{f.name}" for f in kept.schema["value"].dataType.fields)
    return kept.select(
        "key.key", F.col(n).alias("n"), F.col(f"{top}.id").alias("keep_id"), F.col(f"{top}.file").alias("keep_file"), F.col(f"{top}.at").alias("keep_at"))


def _hits(rows: DataFrame, repeated: DataFrame, few: bool, how: str) -> DataFrame:
    return rows.join(F.broadcast(repeated) if few else repeated, "key", how)


def _stays() -> Column:
    return F.col("file").eqNullSafe(F.col("keep_file")) & F.col("at").eqNullSafe(F.col("keep_at"))


def resolve(
    docs: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_bytes: int = DIGEST_BYTES,
) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of the rows of ``docs``, read from files, under the state ``kept``."""
    repeated = cut_lineage(kept.filter("n > 1"))
    few = repeated.count() <= BROADCAST_ROWS
    text = normalised(F.col(text_col)).alias("full")
    texts = _hits(_located(docs, id_col, text_col, key_bytes, text), repeated, few, "inner")
    # one row per text and task goes on, however many copies there are
    checked = texts.withColumn("is_top", _stays()).groupBy("key", "full").agg(F.max("is_top").alias("same"))
    colliding = cut_lineage(checked.filter("not same").select("key").distinct())

    rows = _hits(_located(docs, id_col, text_col, key_bytes), repeated, few, "left")
    out = ("id", "digest", "keep_id", "n", "stays")
    found = rows.withColumns({
        "keep_id": F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id")),
        "stays": F.col("n").isNull() | _stays(), "n": F.coalesce("n", F.lit(1))})
    if not colliding.isEmpty():
        among = texts.drop("n", "keep_id", "keep_file", "keep_at").join(colliding, "key", "left_semi")
        classes = among.groupBy("key", "full").agg(F.count("*").alias("n"), F.max(F.struct("id", "file", "at")).alias("top"))
        classes = classes.select("key", "full", "n", F.col("top.id").alias("keep_id"), F.col("top.file").alias("keep_file"), F.col("top.at").alias("keep_at"))
        exact = among.join(classes, ["key", "full"]).withColumn("stays", _stays())
        found = found.join(colliding, "key", "left_anti").select(*out).unionByName(exact.select(*out))
    return found.select(
        F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"), F.col("stays").alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(
    spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", checkpoint: str | None = None,
    batch_bytes: int = BATCH_BYTES, key_bytes: int = DIGEST_BYTES,
) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row of the Parquet files in ``path``.

    With the ``checkpoint`` of an earlier call the stream goes on where it ended.
    """
    checkpoint = checkpoint or f"{scratch_folder(spark)}/exact-{uuid.uuid4().hex}"
    observe(spark, path, checkpoint, id_col, text_col, batch_bytes, key_bytes)
    return resolve(spark.read.parquet(path), state(spark, checkpoint), id_col, text_col, key_bytes)


SQL = f"""
WITH named AS (SELECT doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM named"""
