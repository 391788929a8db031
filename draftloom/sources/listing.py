"""Directory listings as a Python data source: a partition per subtree, and rows for what could not be read."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import crawl, is_safe

SCHEMA = "path string, size bigint, mtime timestamp, error string"


@dataclass
class _Subtree(InputPartition):
    """A folder to be listed, relative to the root, and whether with all below it."""

    folder: str
    deep: bool


class _ListingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = _local(options["path"])
        self.depth = int(options.get("depth", "1"))

    def partitions(self) -> list[_Subtree]:
        """Folders of ``depth`` levels, which are few, are listed when the scan is planned; each one below is a task."""
        found, level = [], [""]
        for _ in range(self.depth):
            found += [_Subtree(folder, False) for folder in level]
            level = [f"{folder}/{e.name}".lstrip("/") for folder in level for e in _entries(self.root, folder) if not isinstance(e, str) and e.is_dir(follow_symlinks=False)]
        return found + [_Subtree(folder, True) for folder in sorted(level)]

    def read(self, partition: _Subtree) -> Iterator[tuple]:
        """Entries by metadata alone. A folder or an entry that can't be read is a row with an error; the rest goes on."""
        folders = [partition.folder]
        while folders:
            folder = folders.pop()
            for entry in _entries(self.root, folder):
                if isinstance(entry, str):
                    yield folder, None, None, entry
                    continue
                path = f"{folder}/{entry.name}".lstrip("/")
                try:
                    if entry.is_dir(follow_symlinks=False):
                        if partition.deep:
                            folders.append(path)
                        continue
                    stat = entry.stat()
                except OSError as problem:
                    yield path, None, None, type(problem).__name__
                    continue
                yield path, stat.st_size, datetime.fromtimestamp(stat.st_mtime, timezone.utc), None


def _local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:").rstrip("/") or "/"


def _entries(root: str, folder: str) -> list:
    """What lies directly in a folder, by name; the name of the error alone where it can't be opened."""
    try:
        with os.scandir(f"{root}/{folder}") as found:
            return sorted(found, key=lambda e: e.name)
    except OSError as problem:
        return [type(problem).__name__]


class ListingSource(DataSource):
    """``spark.read.format("drawing_listing").option("depth", 1).load(root)`` on a mount that all executors share."""

    @classmethod
    def name(cls) -> str:
        return "drawing_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _ListingReader(self.options)


def list_files(spark: SparkSession, root: str, depth: int = 1) -> DataFrame:
    """(path, size, mtime, error) of all below ``root``; paths are relative to it. In a store that only Spark reaches, its own
    listing is taken, which has no rows for errors."""
    if "://" in root and not root.startswith("file:"):
        return crawl(spark, root, extensions=()).withColumn("error", F.lit(None).cast("string"))
    spark.dataSource.register(ListingSource)
    return spark.read.format("drawing_listing").option("depth", depth).load(root)


def read_listed(wanted: DataFrame, root: str, limit: int = 1 << 28) -> DataFrame:
    """``wanted`` (path, relative) with content and error: the bytes of files below ``root``.

    Paths that are absolute or have parent steps are refused before anything is opened, and so are those that links lead out of
    the root; missing and unreadable files are rows with an error. ``limit``: files of more bytes are an error.
    """
    import pyarrow as pa

    base = _local(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside = os.path.realpath(base)
        for batch in batches:
            for path, safe in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                content = error = None
                try:
                    real = os.path.realpath(f"{base}/{path}")
                    if not safe or os.path.commonpath([inside, real]) != inside:
                        error = "unsafe path"
                    elif os.path.getsize(real) > limit:
                        error = "too large"
                    else:
                        with open(real, "rb") as file:
                            content = file.read()
                except (OSError, ValueError) as problem:
                    error = type(problem).__name__
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([content], pa.binary()), pa.array([error], pa.string())], ["path", "content", "error"])

    path = F.regexp_replace("path", r"\\", "/")
    return wanted.select(path.alias("path"), F.coalesce(is_safe(path), F.lit(False)).alias("safe")).mapInArrow(run, "path string, content binary, error string")
