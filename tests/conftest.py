import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sysloom.schemas import SYSCALL_SCHEMA  # noqa: E402
from sysloom.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints"))).getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture
def events(spark):
    """events([(type, process, file), ...]) -> event table; extra keys override columns."""
    def make(rows, run="r1"):
        data = []
        for i, row in enumerate(rows):
            kind, process, file, *more = row
            extra = more[0] if more else {}
            event = {
                "package_name": "pkg", "container_id": "c" * 20, "detonation_id": run, "pid": 100 + i, "ppid": 1,
                "timestamp_ns": i, "event_type": kind, "process_name": process, "filename": file, "captured_at": "",
                "connect_port": 0, "connect_ip": 0, "write_bytes": 0, "write_fd": 0, **extra}
            seq = event.pop("seq", i)
            data.append((*[event[f.name] for f in SYSCALL_SCHEMA], seq))
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SYSCALL_SCHEMA) + ", seq long"
        return spark.createDataFrame(data, schema)
    return make
