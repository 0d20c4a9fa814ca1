"""A table that grows by versions, for the batches of a stream.

Each version is a folder of its own that a replay overwrites, so writing it twice adds nothing.
With keys the newest version of a key counts (an upsert).  Versions are merged like the
levels of a log-structured tree: every ``fan`` versions into one folder, every ``fan`` of
those into a larger one.  A row is rewritten once per level, and the number of folders grows
with the logarithm of the versions.  A folder counts once it is complete and as long as no
complete folder spans it; what has been spanned is deleted a version later, so that readers
of the version before still find their files.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

FAN = 32


class LogTable:
    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, keys: Sequence[str] = (), fan: int = FAN):
        fields = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
        self.spark, self.path, self.keys, self.fan = spark, path.rstrip("/"), tuple(keys), fan
        self.schema = StructType([*fields, StructField("version", LongType())])

    # ------------------------------------------------------------ folders
    def _path(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _complete(self) -> list[tuple[int, int]]:
        files, top = self._path()
        if not files.exists(top):
            return []
        spans = []
        for status in files.listStatus(top):
            found = re.fullmatch(r"(\d{12})-(\d{12})", status.getPath().getName())
            if found and files.exists(self._path(f"{found[0]}/_SUCCESS")[1]):
                spans.append((int(found[1]), int(found[2])))
        return spans

    @staticmethod
    def _within(a: tuple[int, int], b: tuple[int, int]) -> bool:
        return a != b and b[0] <= a[0] and a[1] <= b[1]

    def spans(self, first: int = 0, before: int | None = None) -> list[tuple[int, int]]:
        """Ranges of versions whose folders make up the table."""
        spans = [s for s in self._complete() if s[0] >= first and (before is None or s[1] < before)]
        return sorted(s for s in spans if not any(self._within(s, other) for other in spans))

    @staticmethod
    def _name(span: tuple[int, int]) -> str:
        return f"{span[0]:012d}-{span[1]:012d}"

    # ------------------------------------------------------------ rows
    def append(self, rows: DataFrame, version: int) -> None:
        """Write one version; it replaces what an earlier attempt at it left."""
        if any(self._within((version, version), s) for s in self._complete()):
            return
        rows = rows.withColumn("version", F.lit(version).cast("long")).select(*[F.col(f.name).cast(f.dataType) for f in self.schema])
        rows.write.mode("overwrite").parquet(f"{self.path}/{self._name((version, version))}")

    def read(self, before: int | None = None, first: int = 0) -> DataFrame:
        """All rows of the versions from ``first`` to before ``before``."""
        paths = [f"{self.path}/{self._name(s)}" for s in self.spans(first, before)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def at(self, version: int) -> DataFrame:
        return self.read(version + 1, version)

    def _newest(self, rows: DataFrame) -> DataFrame:
        last = rows.groupBy(*self.keys).agg(F.max("version").alias("version"))
        return rows.join(last, [*self.keys, "version"], "left_semi")

    def latest(self, before: int | None = None, where: Column | None = None) -> DataFrame:
        """Rows of each key's newest version.

        ``where`` is applied first and reaches the scan, so it must hold for the newer
        version of a key whenever it holds for an older one.
        """
        rows = self.read(before)
        return self._newest(rows if where is None else rows.filter(where))

    def compact(self, version: int) -> None:
        """Merge the full levels below ``version``, which must not be written any more."""
        files, _ = self._path()
        spans = self._complete()
        for s in spans:
            if any(self._within(s, other) for other in spans):
                files.delete(self._path(self._name(s))[1], True)
        size = self.fan
        while version > 0 and version % size == 0:
            span = (version - size, version - 1)
            inside = [s for s in self.spans(span[0], version)]
            if len(inside) > 1:
                rows = self.read(version, span[0])
                rows = self._newest(rows) if self.keys else rows
                rows.select(*self.schema.names).hint("rebalance").write.mode("overwrite").parquet(f"{self.path}/{self._name(span)}")
            size *= self.fan
