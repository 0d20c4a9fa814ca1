"""Column expressions shared by the operators.  All stay on the JVM side."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import packs

# Every character that Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
NEWLINE = "\r\n|\r|\n"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sql_text(value: str) -> str:
    """Spark SQL string literal.  Lists of rules become one SQL expression: building
    them from Column calls costs several gateway round trips per rule."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_list(values: Sequence[str]) -> str:
    return ", ".join(sql_text(v) for v in values)


def _any_sql(function: str, column: str, values: Sequence[str]) -> Column:
    tests = [f"{function}({column}, {sql_text(v)})" for v in packs.checked(values)]
    return F.expr("(" + " OR ".join(tests or ["false"]) + ")")


def parse_json(rows: DataFrame, column: str, schema: str | StructType, keep: Sequence[str]) -> DataFrame:
    """Kept columns plus the fields of a JSON text; ``_bad`` in the schema takes
    texts that do not fit it.

    The fields come out of a generator: a later filter on one of them is not
    pushed below it, so each text is parsed exactly once.
    """
    document = F.from_json(column, schema, {"columnNameOfCorruptRecord": "_bad"})
    return rows.select(*keep, F.inline(F.array(document)))


def once(value: Column) -> Column:
    """Generator form of a costly expression, for the same reason as above."""
    return F.explode_outer(F.array(value))


def strip_ws(c: Column | str) -> Column:
    return F.btrim(_col(c), F.lit(WHITESPACE))


def split_lines(c: Column | str) -> Column:
    """Lines of a text with any line ends; the plain case needs no regex."""
    text = _col(c)
    return F.when(text.contains("\r"), F.split(text, NEWLINE)).otherwise(F.split(text, "\n"))


def basename(c: Column | str) -> Column:
    return F.substring_index(_col(c), "/", -1)


def ipv4(c: Column | str) -> Column:
    """Network-order integer to dotted quad, low byte first."""
    ip = _col(c).cast("long")
    return F.concat_ws(".", *[F.shiftright(ip, s).bitwiseAND(255).cast("string") for s in (0, 8, 16, 24)])


def is_external(ip: Column | str) -> Column:
    """Not loopback (127.*) and not 0.0.0.0, tested on the integer."""
    ip = _col(ip).cast("long")
    return (ip.bitwiseAND(0xFF) != 127) & (ip.bitwiseAND(0xFFFFFFFF) != 0)


def is_known_cdn(ip: Column | str) -> Column:
    """104.16.*: the registry's delivery network."""
    return _col(ip).cast("long").bitwiseAND(0xFFFF) == 104 + 16 * 256


def swap_port(c: Column | str) -> Column:
    """Big-endian port read as a little-endian number, put right."""
    p = _col(c).cast("long")
    return p.bitwiseAND(255) * 256 + F.shiftright(p, 8).bitwiseAND(255)


def event_type_name(code: Column | str) -> Column:
    code = _col(code)
    names = reduce(lambda acc, kv: acc.when(code == kv[0], kv[1]), packs.EVENT_TYPES.items(), F)
    return names.otherwise("UNKNOWN")


def starts_with_any(column: str, prefixes: Sequence[str]) -> Column:
    return _any_sql("startswith", column, prefixes)


def contains_any(column: str, needles: Sequence[str]) -> Column:
    return _any_sql("contains", column, needles)


def is_safe_path(column: str, prefixes: Sequence[str] = packs.SAFE_PREFIXES) -> Column:
    return starts_with_any(column, prefixes)


def is_nonstandard_process(c: Column | str, expected: Sequence[str] = packs.EXPECTED_PROCESSES) -> Column:
    return ~_col(c).isin(*expected)


def severity_rank(c: Column | str) -> Column:
    c = _col(c)
    ranks = reduce(lambda acc, kv: acc.when(c == kv[1], kv[0]), enumerate(packs.SEVERITIES), F)
    return ranks.otherwise(len(packs.SEVERITIES))


def risk_band(score: Column | str) -> Column:
    s = _col(score)
    return (F.when(s >= packs.MALICIOUS_FROM, "MALICIOUS")
            .when(s >= packs.SUSPICIOUS_FROM, "SUSPICIOUS").otherwise("SAFE"))


def recommendation(risk: Column | str) -> Column:
    r = _col(risk)
    return reduce(lambda acc, kv: acc.when(r == kv[0], kv[1]), packs.RECOMMENDATIONS.items(), F)


def container_id(line: Column | str) -> Column:
    """Short container id of a cgroup line: the three layouts in turn, '' if none fits."""
    line = _col(line)

    def after(marker: str) -> Column:
        start = F.instr(line, marker) + F.lit(len(marker))
        return F.when(line.contains(marker), F.substr(line, start))

    def short(text: Column) -> Column:
        return F.when(F.length(text) >= 12, F.substring(text, 1, 12))

    return F.coalesce(
        short(F.substring_index(after("docker-"), ".", 1)),
        short(after("/docker/")),
        short(after("/containerd/")),
        F.lit(""),
    )


def in_container(line: str) -> Column:
    return contains_any(line, ("docker", "containerd"))


def sanitize_name(name: Column | str) -> Column:
    clean = F.regexp_replace(_col(name), "[^a-zA-Z0-9_.-]", "-")
    clean = F.ltrim(clean, F.lit("-_."))
    return F.when(clean == "", "pkg").otherwise(clean)


def package_spec(name: Column | str, version: Column | str) -> Column:
    n, v = _col(name), F.coalesce(_col(version), F.lit(""))
    return F.when(v != "", F.concat(n, F.lit("@"), v)).otherwise(n)


def split_spec(spec: Column | str) -> tuple[Column, Column]:
    """``name@version`` to (name, version); a leading @ belongs to the scope."""
    s = _col(spec)
    parts = r"(?s)^(.+)@([^@]*)$"
    hit = s.rlike(parts)
    return (F.when(hit, F.regexp_extract(s, parts, 1)).otherwise(s),
            F.when(hit, F.regexp_extract(s, parts, 2)).otherwise(F.lit("")))


def detonation_id(package: Column | str, started: Column | str) -> Column:
    stamp = F.date_format(_col(started), "yyyy-MM-dd-HHmmss")
    return F.concat(F.lit("det-"), stamp, F.lit("-"), _col(package))


def strip_frame_header(line: Column | str) -> Column:
    """Drop the 8-byte log frame header (first byte 0, 1 or 2); lengths are in bytes."""
    line = _col(line)
    framed = (F.octet_length(line) > 8) & F.substring(line, 1, 1).isin("\x00", "\x01", "\x02")
    rest = F.substr(line.cast("binary"), F.lit(9)).cast("string")
    return F.when(framed, F.make_valid_utf8(rest)).otherwise(line)


def log_lines(log: Column | str) -> Column:
    """Lines of the trimmed text; no lines for an empty log."""
    log = _col(log)
    return F.when(log == "", F.array().cast("array<string>")).otherwise(F.split(strip_ws(log), "\n"))


def count_lines(log: Column | str) -> Column:
    return F.size(log_lines(log))


def report_id(det: Column | str) -> Column:
    return F.replace(_col(det), F.lit("/"), F.lit("_"))


def triage_route(score: Column | str) -> Column:
    s = _col(score)
    return (F.when(s < packs.REVIEW_FROM, "clearly safe")
            .when(s <= packs.REVIEW_TO, "llm").otherwise("clearly malicious"))
