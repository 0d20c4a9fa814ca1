"""WARC archives: segmented records with chunked payloads, written and put together again.

Archives are written and read by Spark's text source, which keeps bytes as they are: each row
is a record, so files of any size are split among tasks and no task holds more than a record.
The reader splits at the version line.  A record whose declared length reaches beyond its row
holds that line in its block; the rows of such a file, and of no other, are put in order and
joined back by their declared lengths.

Segmented records are gathered by origin id (a group is one record), ordered by segment
number, and count as whole if the numbers run from one without a gap and the bytes add up to
the total that the last segment states.  Equal segments read twice count once.  A record that
fails has its reason in ``problem`` and no payload.

Rows: a null payload is empty and archived like any other; repeated rows of a page are one
page; ids may be null.  Of equal payloads the smallest id is the response and the others
revisit it.  An empty table gives archives without a record and an empty result.  Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..session import cut_lineage

VERSION = "WARC/1."
CRLF = "\r\n"
CHUNK_BYTES = 4096
SEGMENT_BYTES = 16_384
_URN = "urn:archive:page:"
_HTTP = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Transfer-Encoding: chunked{CRLF}{CRLF}"
#: Digits of base 32 as Spark writes them and as digests do.
_DIGITS, _LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: 20 bits, which are four digits, at a time."""
    hexed = F.sha1(data)
    digits = [F.lpad(F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*digits), _DIGITS, _LETTERS)


def _slices(data: Column, size: int, length: Column) -> Column:
    """Numbered parts of ``data`` (none of an empty one), as (no, part)."""
    last = F.floor((length - 1) / size)
    numbers = F.when(length > 0, F.sequence(F.lit(0).cast("long"), last)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(numbers, lambda k: F.struct(
        (k + 1).alias("no"), F.substring(data, (k * size + 1).cast("int"), F.lit(size)).alias("part")))


def chunked(payload: Column) -> Column:
    """HTTP's chunked framing of a binary column, as text whose bytes are the framed ones."""
    parts = F.transform(_slices(payload, CHUNK_BYTES, F.octet_length(payload)), lambda s: F.concat(
        F.lower(F.hex(F.octet_length(s["part"]))), F.lit(CRLF), s["part"].cast("string"), F.lit(CRLF)))
    return F.concat(F.array_join(parts, ""), F.lit(f"0{CRLF}{CRLF}"))


def _lines(*fields: tuple[str, Column]) -> Column:
    """Header lines; a null value has no line."""
    return F.concat_ws(CRLF, F.lit(f"{VERSION}1"), *[F.when(v.isNotNull(), F.concat(F.lit(f"{name}: "), v.cast("string"))) for name, v in fields], F.lit(CRLF))


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", compression: str = "gzip",
) -> None:
    """One record per page: the response with the smallest id of equal payloads, revisits of it for the others.

    Compressed archives are read by one task each, uncompressed ones (``none``) are split.
    """
    data = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), data.alias("data"))
    rows = rows.withColumns({"digest": sha1_base32(F.col("data")), "bytes": F.octet_length("data")})
    # only payloads that occur again are joined, so pages without a copy need not move
    firsts = rows.groupBy("digest", "bytes").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    rows = rows.join(firsts, ["digest", "bytes"], "left")
    name = lambda c: F.concat(F.lit(_URN), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(":"), F.col("digest"))
    angle = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    block = F.when(revisit, F.lit("")).otherwise(F.concat(F.lit(_HTTP), chunked(F.col("data")))).cast("binary")
    rows = rows.select("url", "digest", revisit.alias("revisit"), name("id").alias("name"), name("first").alias("to"), block.alias("block"))
    length = F.octet_length("block")
    cut = F.when(length > 0, _slices(F.col("block"), SEGMENT_BYTES, length)).otherwise(
        F.array(F.struct(F.lit(1).cast("long").alias("no"), F.col("block").alias("part"))))
    rows = rows.withColumn("total", length).withColumn("segment", F.explode(cut)).withColumn("no", F.col("segment.no")).withColumn("part", F.col("segment.part"))
    many, later = F.col("total") > SEGMENT_BYTES, F.col("no") > 1
    last = F.col("no") == F.ceil(F.col("total") / SEGMENT_BYTES)
    header = _lines(
        ("WARC-Type", F.when(later, F.lit("continuation")).when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        ("WARC-Record-ID", angle(F.when(later, F.concat("name", F.lit(":"), F.col("no").cast("string"))).otherwise(F.col("name")))),
        ("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        ("WARC-Refers-To", F.when(F.col("revisit"), angle(F.col("to")))),
        ("WARC-Segment-Number", F.when(many, F.col("no"))), ("WARC-Segment-Origin-ID", F.when(many & later, angle(F.col("name")))),
        ("WARC-Segment-Total-Length", F.when(many & last, F.col("total"))), ("Content-Length", F.octet_length("part")))
    rows.select(F.concat(header, F.col("part").cast("string"))).write.option("lineSep", CRLF + CRLF).option("compression", compression).text(path)


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract("header", rf"(?im)^{name}:[ \t]*<?([^\r\n>]*)", 1), F.lit(""))


def _parse(rows: DataFrame) -> DataFrame:
    """Header, declared length and bytes after the header of rows that begin behind the version's major part."""
    rows = rows.withColumn("header", F.substring_index("value", CRLF + CRLF, 1))
    return rows.withColumns({
        "declared": F.when(F.col("header").rlike(r"^[01]\r\n"), _field("Content-Length").try_cast("long")),
        "have": F.octet_length("value") - F.octet_length("header") - 4})


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives below ``path``: header fields, block, and ``problem`` if one is damaged."""
    raw = spark.read.option("lineSep", VERSION).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("row"))
    rows = _parse(raw)
    odd_files = rows.filter("have < declared").select("file").distinct()
    plain = rows.join(F.broadcast(odd_files), "file", "left_anti").filter("value <> ''").select("value", "header", "declared", "have")

    def owners(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["at", "row"])
        end, owner, out = 0, 0, []
        position = 0
        for row, size, need in zip(frame["row"], frame["size"], frame["need"]):
            if position >= end:  # not inside the record before
                owner, end = row, position + need
            out.append(owner)
            position += size + len(VERSION)
        return frame.assign(owner=out)[["row", "owner"]]

    odd = rows.join(F.broadcast(odd_files), "file", "left_semi")
    # sizes only: the rows of one file, without their blocks
    sizes = odd.selectExpr("file", "at", "row", "octet_length(value) AS size", "coalesce(octet_length(header) + 4 + declared, 1) AS need")
    owned = sizes.groupBy("file").applyInPandas(owners, "row long, owner long")
    joined = odd.join(owned, "row").groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("at", "row", "value"))).alias("parts"))
    mended = _parse(joined.select(F.array_join(F.transform("parts", lambda p: p["value"]), VERSION).alias("value")).filter("value <> ''"))
    rows = plain.unionByName(mended.select("value", "header", "declared", "have"))
    whole = F.col("have") >= F.col("declared")
    block = F.substring(F.col("value").cast("binary"), F.octet_length("header") + 5, F.col("declared").cast("int"))
    return rows.select(
        _field("WARC-Type").alias("type"), _field("WARC-Record-ID").alias("record_id"), _field("WARC-Target-URI").alias("url"),
        F.regexp_replace(_field("WARC-Payload-Digest"), "^sha1:", "").alias("digest"), _field("WARC-Refers-To").alias("refers_to"),
        _field("WARC-Segment-Number").try_cast("int").alias("segment"), _field("WARC-Segment-Origin-ID").alias("origin"),
        _field("WARC-Segment-Total-Length").try_cast("long").alias("total"), F.when(whole, block).alias("block"),
        F.when(F.col("declared").isNull(), "no header").when(~whole, "cut off").alias("problem"))


def reassemble(records: DataFrame) -> DataFrame:
    """Records with their segments joined: continuations go to the record of their origin."""
    kept = ("type", "record_id", "url", "digest", "refers_to")
    single = records.filter("segment is null").select(*kept, "block", "problem")
    parts = records.filter("segment is not null").withColumn("key", F.coalesce("origin", "record_id"))
    first = F.max(F.when(F.col("segment") == 1, F.struct(*kept))).alias("first")
    groups = parts.groupBy("key").agg(
        first, F.array_sort(F.collect_set(F.when(F.col("problem").isNull(), F.struct("segment", "block")))).alias("parts"), F.max("total").alias("total"))
    count = F.size("parts")
    gap = F.col("first").isNull() | (count == 0) | (F.element_at("parts", -1)["segment"] != count) | F.col("total").isNull()
    bytes_ = F.aggregate("parts", F.lit(0).cast("long"), lambda s, p: s + F.octet_length(p["block"]))
    problem = F.when(gap, "segment missing").when(bytes_ != F.col("total"), "length differs")
    block = F.array_join(F.transform("parts", lambda p: p["block"].cast("string")), "").cast("binary")
    joined = groups.select(
        *[F.coalesce(F.col(f"first.{c}"), F.col("key") if c == "record_id" else F.lit(None)).alias(c) for c in kept],
        F.when(problem.isNull(), block).alias("block"), problem.alias("problem"))
    return single.unionByName(joined)


def dechunk(framed: bytes) -> bytes | None:
    """Payload of a chunked body; None if the framing is damaged."""
    out, at = [], 0
    while True:
        line = framed.find(b"\r\n", at)
        size = framed[at:line].split(b";")[0].strip() if line >= 0 else b""
        if not size or size.strip(b"0123456789abcdefABCDEF"):
            return None
        length = int(size, 16)
        if not length:
            return b"".join(out)
        end = line + 2 + length
        if framed[end:end + 2] != b"\r\n":
            return None
        out.append(framed[line + 2:end])
        at = end + 2


@F.pandas_udf(BinaryType())
def _body(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for blocks in batches:
        yield blocks.map(_payload)


def _payload(block: bytes | None) -> bytes | None:
    if block is None:
        return None
    head, _, body = block.partition(b"\r\n\r\n")
    lines = (line.partition(b":") for line in head.lower().split(b"\r\n"))
    coded = any(k.strip() == b"transfer-encoding" and b"chunked" in v for k, _, v in lines)
    return dechunk(body) if coded else body


def payloads(records: DataFrame) -> DataFrame:
    """Responses with their payload; a damaged one, or one whose digest differs, has a problem."""
    rows = records.filter("type = 'response'").withColumn("payload", _body("block"))
    rows = rows.withColumn("found", sha1_base32(F.col("payload")))
    problem = F.coalesce("problem", F.when(F.col("payload").isNull(), "framing damaged").when(F.col("found") != F.col("digest"), "digest differs"))
    return rows.select("record_id", "url", F.when(problem.isNull(), F.col("payload")).alias("payload"), F.col("found").alias("payload_digest"), problem.alias("problem"))


def page_id(record_id: Column) -> Column:
    """Id of the page that a record of ``write_archives`` holds."""
    return F.nullif(F.regexp_extract(record_id, rf"^{_URN}([^:]*):", 1), F.lit(""))


def archive_index(records: DataFrame, kind: str = "long") -> DataFrame:
    """Per page of an archive: payload length and digest, record type and what a revisit refers to."""
    # written once: payloads are put together for the responses themselves and for their revisits
    responses = cut_lineage(payloads(records).filter("problem is null").select(
        "record_id", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest"))
    revisits = records.filter("type = 'revisit'").select("record_id", F.col("refers_to").alias("to"))
    found = revisits.join(responses.withColumnRenamed("record_id", "to"), "to").select("record_id", "payload_bytes", "payload_digest", "to")
    rows = responses.withColumn("to", F.lit(None).cast("string")).unionByName(found)
    return rows.select(
        page_id(F.col("record_id")).cast(kind).alias("page_id"), "payload_bytes", "payload_digest",
        F.when(F.col("to").isNull(), "response").otherwise("revisit").alias("record_type"), page_id(F.col("to")).cast(kind).alias("refers_to")).distinct()


#: The index from the pages themselves, by another engine.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, CAST(1 + 5 * (k // 4) AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31 AS BIGINT), 1)
    FOR k IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""
