"""Fixed-width kernel records (320 bytes, little-endian) as event rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as fx
from ..functions.packs import EVENT_TYPES

# --- fixed values: field -> (byte offset, bytes); 300 and 316 are padding ---
LAYOUT = {
    "pid": (0, 4), "ppid": (4, 4), "timestamp_ns": (8, 8), "event_code": (16, 4), "process_name": (20, 16),
    "filename": (36, 256), "connect_port": (292, 4), "connect_ip": (296, 4), "write_bytes": (304, 8), "write_fd": (312, 4),
}
RECORD_BYTES = 320
TEXT_FIELDS = ("process_name", "filename")
SIGNED_FIELDS = ("write_fd",)
FIELDS = ("pid", "ppid", "timestamp_ns", "event_type", "process_name", "filename", "connect_port", "connect_ip", "write_bytes", "write_fd")


def _unsigned32(offset: int) -> str:
    """Four little-endian bytes: put in reverse order and read as base 16."""
    swapped = ", ".join(f"substring(_r, {offset + i}, 1)" for i in (4, 3, 2, 1))
    return f"CAST(conv(hex(concat({swapped})), 16, 10) AS BIGINT)"


def _integer(name: str) -> Column:
    offset, width = LAYOUT[name]
    low = _unsigned32(offset)
    if width == 8:  # the upper half carries the sign of the long
        return F.expr(f"shiftleft({_unsigned32(offset + 4)}, 32) | {low}")
    if name in SIGNED_FIELDS:
        return F.expr(f"shiftright(shiftleft({low}, 32), 32)")
    return F.expr(low)


def _text(name: str) -> Column:
    """Bytes up to the first NUL; invalid UTF-8 becomes the replacement character."""
    offset, width = LAYOUT[name]
    return F.make_valid_utf8(F.substring_index(F.substring("_r", offset + 1, width).cast("string"), "\x00", 1))


def decode_raw_records(records: DataFrame, column: str = "record") -> DataFrame:
    """Records of the right length as events; other columns are kept."""
    others = [c for c in records.columns if c != column]
    fields = [(_text if n in TEXT_FIELDS else _integer)(n).alias(n) for n in LAYOUT]
    raw = records.select(*others, fx.once(F.col(column)).alias("_r"))
    whole = raw.filter(F.octet_length("_r") >= RECORD_BYTES).select(*others, *fields)
    return whole.withColumn("event_type", fx.event_type_name("event_code")).drop("event_code")


def encode_raw_records(events: DataFrame, column: str = "record") -> DataFrame:
    """Events packed into kernel records, for fixtures and replays."""
    code = F.coalesce(*[F.when(F.col("event_type") == n, c) for c, n in EVENT_TYPES.items()], F.lit(0)).cast("long")

    def integer(name: str, width: int) -> str:
        big_endian = f"unhex(lpad(hex({name}), 16, '0'))"
        return "concat(" + ", ".join(f"substring({big_endian}, {8 - i}, 1)" for i in range(width)) + ")"

    def text(name: str, width: int) -> str:
        # the kernel keeps room for the closing NUL
        return f"rpad(substring(CAST({name} AS BINARY), 1, {width - 1}), {width}, X'00')"

    zeros = lambda n: f"X'{'00' * n}'"
    parts, end = [], 0
    for name, (offset, width) in LAYOUT.items():
        if offset > end:
            parts.append(zeros(offset - end))
        parts.append((text if name in TEXT_FIELDS else integer)(name, width))
        end = offset + width
    parts.append(zeros(RECORD_BYTES - end))
    return events.withColumn("event_code", code).select("seq", F.expr(f"concat({', '.join(parts)})").alias(column))
