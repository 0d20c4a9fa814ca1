"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_folder
from . import bpe, decontaminate, exact, kdtree, language, lloyd, passages, quality, simhash, sketch, toxicity, warc, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """A file of the public tokenizers; read by the driver only."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_warc(spark, d):
    folder = f"{scratch_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, d, "pages"), folder)
    return warc.archive_index(warc.reassemble(warc.read_records(spark, folder)))


SQL["op1_warc"] = warc.SQL


@query
def op2_language(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    found = language.identify(docs, vocabulary("piece_bpe_32k.model"))
    return found.select("doc_id", language.held_out("doc_id").alias("held_out"), "lang_pred", "score", "lang")


#: Words of 64 bits in the map of labelled ids, at most.
ID_WORDS = 1 << 20


def likely_in(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``rows`` without most of those whose key is not among ``ids``; none of the others is lost.

    The hashes of the ids set bits in a map of bounded size, which is broadcast.  It only spares the
    shuffle of rows that the join to follow drops.
    """
    place = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(ID_WORDS * 64))
    word, bit = F.shiftright(place, 6), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    bits = ids.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    return rows.join(F.broadcast(bits), (word == F.col("_word")) & (F.col("_bits").bitwiseAND(bit) != 0), "left_semi")


def labelled(spark: SparkSession, d: str, label: str) -> DataFrame:
    """(doc_id, text, label) of all labelled documents that are not held out.

    The labels grow with the documents, so they are joined by shuffle at every size; documents
    that have no label are left out before, as far as a map of bits tells them.
    """
    usable = F.col("doc_id").isNotNull() & ~language.held_out("doc_id") & F.col(label).isin(0, 1)
    labels = table(spark, d, "labels").filter(usable).select("doc_id", F.col(label).cast("int").alias("label"))
    docs = likely_in(table(spark, d, "documents").select("doc_id", "text"), labels, "doc_id")
    return docs.join(labels.hint("merge"), "doc_id").select("doc_id", "text", "label")


@query
def op3_toxicity(spark, d):
    weights = toxicity.fit(labelled(spark, d, "toxic"))
    docs = table(spark, d, "documents").select("doc_id", language.held_out("doc_id").alias("held_out"), "text")
    return toxicity.score(docs, weights, threshold=0.3).drop("text")


@query
def op4_kdtree(spark, d):
    return kdtree.shard(table(spark, d, "documents"), 40)


@query
def op5_passages(spark, d):
    return passages.repeated_passages(table(spark, d, "documents"), min_words=50, similarity=0.8)


@query
def op6_quality(spark, d):
    model = quality.fit(labelled(spark, d, "quality"))
    docs = table(spark, d, "documents").select("doc_id", language.held_out("doc_id").alias("held_out"), "text")
    return quality.score(docs, model, threshold=0.7).drop("text")


@query
def op7_bpe(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, vocabulary("byte_bpe_50k.json")).drop("text")


@query
def op8_simhash(spark, d):
    return simhash.near_duplicates(table(spark, d, "documents"), size=4, max_bits=4)


@query
def op9_sketch(spark, d):
    return sketch.against_neighbours(table(spark, d, "documents"))


@query
def op10_decontaminate(spark, d):
    return decontaminate.leaks(table(spark, d, "documents"), table(spark, d, "benchmark"), window=20, similarity=0.8)


SQL["op10_decontaminate"] = decontaminate.SQL


@query
def op11_lloyd(spark, d):
    return lloyd.cluster(table(spark, d, "embeddings"), dimensions=64, clusters=40, rounds=5)


SQL["op11_lloyd"] = lloyd.SQL


@query
def op12_exact(spark, d):
    return exact.deduplicate(spark, f"{d}/documents.parquet")


SQL["op12_exact"] = exact.SQL


@query
def op13_whitening(spark, d):
    return whitening.whiten(table(spark, d, "embeddings"), keep=8)
