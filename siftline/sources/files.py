"""Directories and archives as one relation of scannable files.

Spark's own file listing hides names that begin with '_' or '.'; a scanner must
not. So the driver lists, and a Python data source reads in partitions of about
equal size; archives are opened once and give their members, so a partition holds
one file or member at a time. For object stores scan_store() uses Spark's reader.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import ARCHIVE, SCANNABLE, file_extension, normal_path
from .archive import archive_members, member_suffix, members, read_directory

SCHEMA = "file string, ext string, content binary, length bigint, archive string, error string"
PARTITION_BYTES, PARTITION_FILES = 64 << 20, 5000


def extension(path: str) -> str:
    """Lower-case extension; a name whose only dot leads has none."""
    return os.path.splitext(os.path.basename(path))[1].lower()


def list_files(root: str) -> Iterator[tuple[str, int, str | None]]:
    """(path, size, error) of regular files of the known types, without following directory links; unreadable folders give an error row."""
    problems: list[OSError] = []
    for folder, _, names in os.walk(root, followlinks=False, onerror=problems.append):
        for name in sorted(names):
            if extension(name) in (*SCANNABLE, ARCHIVE):
                path = os.path.join(folder, name)
                try:
                    if os.path.isfile(path) and (size := os.path.getsize(path)):
                        yield path, size, None
                except OSError as e:
                    yield path, 0, str(e)
    for e in problems:
        yield str(e.filename), 0, str(e)


@dataclass
class Part(InputPartition):
    files: list[tuple[str, int, str | None]]


class FilesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]

    def partitions(self) -> list[Part]:
        out, size = [Part([])], 0
        for f in list_files(self.root):
            if out[-1].files and (size + f[1] > PARTITION_BYTES or len(out[-1].files) >= PARTITION_FILES):
                out.append(Part([]))
                size = 0
            out[-1].files.append(f)
            size += f[1]
        return out

    def read(self, partition: Part) -> Iterator[tuple]:
        for path, size, error in partition.files:
            name, ext = path.replace("\\", "/"), extension(path)
            try:
                if error:
                    yield name, ext, None, 0, None, error
                    continue
                with open(path, "rb") as f:
                    if ext != ARCHIVE:
                        data = f.read()
                        if data:
                            yield name, ext, data.replace(b"\r\n", b"\n"), len(data), None, None
                        continue
                    archive = read_directory(f)
                    if not archive.valid:
                        yield name, ext, None, size, name, archive.error
                        continue
                    for e, data in members(f, archive, size):
                        yield f"{name}/{e.filename}", member_suffix(e.filename), data, len(data), name, None
            except OSError as e:
                yield name, ext, None, 0, None, str(e)


class FilesSource(DataSource):
    """spark.read.format('siftline').load(directory)"""

    @classmethod
    def name(cls) -> str:
        return "siftline"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FilesReader:
        return FilesReader(self.options)


def read_directory_tree(spark: SparkSession, root: str) -> DataFrame:
    """(file, ext, content, length, archive, error) of a directory that driver and executors both see."""
    spark.dataSource.register(FilesSource)
    return spark.read.format("siftline").load(str(root))


def _any_case(ext: str) -> str:
    return "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext)


def scan_store(spark: SparkSession, path: str) -> DataFrame:
    """The same through Spark's binary reader, for object stores: loose files, and the members of archives.

    It leaves out names that begin with '_' or '.', and an archive is one value, so of 2 GB at most.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    loose = raw.option("pathGlobFilter", "{" + ",".join(map(_any_case, SCANNABLE)) + "}").load(path).where("length > 0")
    content = F.encode(F.replace(F.decode(F.col("content"), "ISO-8859-1"), F.lit("\r\n"), F.lit("\n")), "ISO-8859-1")
    none = F.lit(None).cast("string")
    loose = loose.select(normal_path(F.col("path")).alias("file"), file_extension(F.col("path")).alias("ext"), content.alias("content"), "length", none.alias("archive"), none.alias("error")).where(F.col("ext").isin(*SCANNABLE))
    packed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", _any_case(ARCHIVE)).load(path).where("length > 0")
    found = archive_members(packed.select("path", "content"))
    return loose.union(found.select("file", "ext", "content", F.length("content").cast("bigint").alias("length"), "archive", "error"))
