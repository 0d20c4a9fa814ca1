"""Archives written and read again, damaged ones included."""

import base64
import hashlib
import os

import duckdb
import pytest

from sysloom.llm import warc
from sysloom.llm.queries import QUERIES, SQL
from tools.compare import compare


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_round_trip_of_all_kinds_of_payloads(spark, tmp_path):
    big = "häß " * 40_000
    data = [(1, "u", "same"), (2, "u", "same"), (3, None, None), (4, "u", ""), (5, "u\r\nX: y", big), (6, "u", big),
            (7, "u", "about WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n text"), (8, "u", "0\r\n\r\n"), (9, "u", "x"), (9, "u", "x"), (None, "u", "no id")]
    pages = spark.createDataFrame([(*r, "clash") for r in data], "page_id long, url string, html string, digest string")
    warc.write_archives(pages, f"{tmp_path}/a")
    records = warc.reassemble(warc.read_records(spark, f"{tmp_path}/a"))
    assert records.filter("problem is not null").count() == 0
    got = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_index(records).collect()}
    first = {}
    for i, _, html in sorted(data, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(html or "", i)
    want = set()
    for i, _, html in data:
        raw, to = (html or "").encode(), first[html or ""]
        want.add((i, len(raw), digest(raw), "response" if to == i else "revisit", None if to == i else to))
    assert got == want
    assert warc.archive_index(records).count() == len(want)


def test_payload_bytes_survive(spark, tmp_path):
    data = bytes(range(256)) * 300
    pages = spark.createDataFrame([(1, "u", bytearray(data))], "page_id long, url string, html binary")
    warc.write_archives(pages, f"{tmp_path}/a")
    row = warc.payloads(warc.reassemble(warc.read_records(spark, f"{tmp_path}/a"))).first()
    assert bytes(row.payload) == data and row.problem is None


def test_damaged_segments_have_a_reason(spark, tmp_path):
    record = lambda kind, name, block, *more: "\r\n".join(
        ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", *more, f"Content-Length: {len(block)}", "", block, "", ""])
    parts = lambda name, numbers, total: "".join(
        record("response" if k == 1 else "continuation", name if k == 1 else f"{name}{k}", f"part{k}", f"WARC-Segment-Number: {k}",
               *([f"WARC-Segment-Origin-ID: <{name}>"] if k > 1 else []), *([f"WARC-Segment-Total-Length: {total}"] if k == 3 else [])) for k in numbers)
    text = parts("whole", (3, 1, 2, 2), 15) + parts("gap", (1, 3), 15) + parts("headless", (2, 3), 15) + parts("short", (1, 2, 3), 99) + parts("endless", (1, 2), 0)
    chunk = "HTTP/1.1 200 OK\r\ntransfer-encoding: chunked\r\n\r\n"
    text += record("response", "chunks", chunk + "3;x=1\r\nabc\r\n2\r\nde\r\n0\r\n\r\n") + record("response", "broken", chunk + "5\r\nabc\r\n0\r\n\r\n")
    text += record("response", "wrong", "abc\r\n\r\nxyz", "WARC-Payload-Digest: sha1:AAAA") + "WARC/1.1\r\nno length\r\n\r\n" + record("response", "cut", "abc")[:-7]
    (tmp_path / "x.warc").write_bytes(text.encode())
    records = warc.reassemble(warc.read_records(spark, str(tmp_path / "x.warc")))
    problems = {r.record_id: r.problem for r in records.collect()}
    assert problems == {"whole": None, "gap": "segment missing", "headless": "segment missing", "short": "length differs", "endless": "segment missing",
                        "chunks": None, "broken": None, "wrong": None, None: "no header", "cut": "cut off"}
    rows = {r.record_id: (r.payload and bytes(r.payload), r.problem) for r in warc.payloads(records).collect()}
    assert rows["chunks"] == (b"abcde", None) and rows["broken"] == (None, "framing damaged") and rows["wrong"] == (None, "digest differs")
    assert bytes(records.filter("record_id = 'whole'").first().block) == b"part1part2part3"


def test_empty_table(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), f"{tmp_path}/a")
    assert warc.archive_index(warc.reassemble(warc.read_records(spark, f"{tmp_path}/a"))).count() == 0


def test_query_against_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{d}/pages.parquet'")
    result, _ = compare(spark, con, "op1_warc", QUERIES["op1_warc"], SQL["op1_warc"], d)
    assert result.startswith("ok") and os.path.exists(d)


@pytest.mark.parametrize("framed,want", [(b"", None), (b"0\r\n\r\n", b""), (b"zz\r\n", None), (b"3\r\nabc\r\n", None), (b"a\r\n0123456789\r\n0\r\n\r\n", b"0123456789")])
def test_dechunk(framed, want):
    assert warc.dechunk(framed) == want
