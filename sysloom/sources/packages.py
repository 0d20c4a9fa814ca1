"""Package sources: directories and tarballs as (package, path, content) rows."""

from __future__ import annotations

import io
import lzma
import tarfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import packs
from ..schemas import PACKAGE_FILE_SCHEMA

TARBALL_SUFFIXES = (".tgz", ".tar.gz")
SUFFIX_GLOB = "*{" + ",".join((*packs.SCANNABLE_SUFFIXES, "package.json")) + "}"


def _text(content):
    """Bytes as text with undecodable bytes left out."""
    # the replacement character cannot be told from a real one afterwards, but
    # no rule pattern contains it
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))


def read_package_files(spark: SparkSession, root: str, package: str | None = None) -> DataFrame:
    """All scannable files and manifests under ``root``; paths are relative to it.

    Without ``package`` the first folder below the root names the package, so
    one call reads a whole mirror.
    """
    root = root.rstrip("/")
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", SUFFIX_GLOB).load(root))
    # Spark reports paths as URIs; the root's own text occurs in them once
    inner = F.regexp_replace(F.substr("path", F.instr("path", root) + F.lit(len(root))), "^/+", "")
    rows = files.select(inner.alias("inner"), _text(F.col("content")).alias("content"))
    if package is not None:
        return rows.select(F.lit(package).alias("package"), F.col("inner").alias("path"), "content")
    below = F.substr("inner", F.instr("inner", "/") + F.lit(1))
    return rows.filter(F.col("inner").contains("/")).select(
        F.substring_index("inner", "/", 1).alias("package"), below.alias("path"), "content")


def _scannable(name: str) -> bool:
    return name.endswith((*packs.SCANNABLE_SUFFIXES, "package.json"))


def _unpacked(package: str, data: bytes) -> Iterator[tuple[str, str | None, str | None, str | None]]:
    """(package, path, content, problem) rows of one tarball, one member in memory at a time.

    npm archives hold everything below package/; others are taken whole.  A damaged or
    shortened archive gives the members before the damage and a row with the problem.
    """
    try:
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as tar:
            below = "package/" if any([m.isfile() and m.name.removeprefix("./").startswith("package/") for m in tar]) else ""
            # a whole archive ends with a block of zeros
            tar.fileobj.seek(tar.offset)
            if tar.fileobj.read(tarfile.BLOCKSIZE) != bytes(tarfile.BLOCKSIZE):
                yield package, None, None, "ends early"
            for member in tar:
                name = member.name.removeprefix("./")
                if not _scannable(name) or not name.startswith(below):
                    continue
                if member.isfile():
                    yield package, name.removeprefix(below), tar.extractfile(member).read().decode("utf-8", errors="ignore"), None
                elif member.issym() or member.islnk():
                    yield package, name.removeprefix(below), None, "link"
    except (tarfile.TarError, EOFError, OSError, zlib.error, lzma.LZMAError) as e:
        yield package, None, None, f"unreadable: {type(e).__name__}"


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["package", "path", "content", "problem"]
    for batch in batches:
        for package, data in zip(batch["package"], batch["content"]):
            for row in _unpacked(package, data):
                yield pd.DataFrame([row], columns=columns)


def unpack_tarballs(spark: SparkSession, glob: str) -> DataFrame:
    """Members of .tgz / .tar.gz archives with a ``problem`` where there is one; an archive is one package.

    Archives are independent and limited in size by the registry, so each is unpacked in
    the task that reads it, member by member.
    """
    archives = spark.read.format("binaryFile").load(glob)
    name = F.regexp_replace(F.substring_index("path", "/", -1), r"\.(tgz|tar\.gz)$", "")
    schema = "package string, path string, content string, problem string"
    return archives.select(name.alias("package"), "content").mapInPandas(_unpack, schema)


def read_package_tarballs(spark: SparkSession, glob: str) -> DataFrame:
    """Readable members of the archives."""
    return unpack_tarballs(spark, glob).filter("problem is null").drop("problem")


def rejected_tarballs(spark: SparkSession, glob: str) -> DataFrame:
    """(package, path, problem): damaged or shortened archives, and links that were not followed."""
    return unpack_tarballs(spark, glob).filter("problem is not null").drop("content")


def load_packages(spark: SparkSession, path: str, package: str | None = None) -> DataFrame:
    """Directory, tarball, or (for anything else) an empty table."""
    if path.endswith(TARBALL_SUFFIXES):
        return read_package_tarballs(spark, path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target) and fs.getFileStatus(target).isDirectory():
        return read_package_files(spark, path, package or path.rstrip("/").rsplit("/", 1)[-1])
    return spark.createDataFrame([], PACKAGE_FILE_SCHEMA)
