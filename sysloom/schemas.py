"""Schemas of the data model.  Spark has no unsigned types, so every unsigned
integer of the telemetry is a LongType."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType, LongType, MapType, StringType, StructField, StructType,
)

REQUIRED_EVENT_FIELDS = {
    "package_name": "string", "container_id": "string", "detonation_id": "string",
    "pid": "long", "ppid": "long", "timestamp_ns": "long",
    "event_type": "string", "process_name": "string",
}
OPTIONAL_EVENT_FIELDS = {
    "filename": "", "captured_at": "", "connect_port": 0, "connect_ip": 0, "write_bytes": 0, "write_fd": 0,
}
EVENT_FIELDS = (*REQUIRED_EVENT_FIELDS, *OPTIONAL_EVENT_FIELDS)


def _event_type(name: str):
    kind = REQUIRED_EVENT_FIELDS.get(name)
    if kind is None:
        kind = "string" if isinstance(OPTIONAL_EVENT_FIELDS[name], str) else "long"
    return StringType() if kind == "string" else LongType()


SYSCALL_SCHEMA = StructType([StructField(n, _event_type(n)) for n in EVENT_FIELDS])

FINDING_FIELDS = ("severity", "category", "description", "evidence", "mitre_id", "mitre_name")
FINDING_TYPE = StructType([StructField(n, StringType()) for n in FINDING_FIELDS])

COUNT_FIELDS = ("events_analyzed", "execve_count", "openat_count", "connect_count", "write_count", "unlink_count")

# A report document.  A run with very many findings is split over several
# documents that share the header fields and differ in part_no.
REPORT_SCHEMA = StructType(
    [StructField("report_id", StringType()), StructField("part_no", LongType()),
     StructField("package_name", StringType()), StructField("detonation_id", StringType()),
     StructField("threat_score", LongType()), StructField("risk_level", StringType()),
     StructField("findings", ArrayType(FINDING_TYPE)), StructField("recommendation", StringType()),
     StructField("analyzed_at", StringType()), StructField("analysis_method", StringType())]
    + [StructField(n, LongType()) for n in COUNT_FIELDS]
    + [StructField("executive_summary", StringType()), StructField("attack_chain", ArrayType(StringType()))]
)

PACKAGE_FILE_SCHEMA = "package string, path string, content string"

REGISTRY_DOCUMENT_SCHEMA = StructType([
    StructField("name", StringType()),
    StructField("error", StringType()),
    StructField("dist-tags", MapType(StringType(), StringType())),
    StructField("versions", MapType(StringType(), StringType())),
    StructField("time", MapType(StringType(), StringType())),
    StructField("maintainers", ArrayType(StructType([StructField("name", StringType())]))),
    StructField("weekly_downloads", LongType()),
])
