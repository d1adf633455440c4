"""Stored indexes: a versioned Parquet directory and a manifest of one row.

``<root>/<name>/data-<created>`` holds the index sorted by flag and block, with
compression; ``<root>/<name>/manifest`` names it, and is written last, so a
reader sees the old index or the new one.  An index is stale if its source is
gone, has another size, or was modified later.
"""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.flags import age
from ..operators.index import SCHEMA, compression_stats, pack, range_width, unpack

VERSION = 1
MANIFEST = "version INT, created BIGINT, source_path STRING, source_size BIGINT, source_mtime BIGINT, layout STRING, build_time_ms BIGINT, compression_ratio DOUBLE, data STRING"
PACKED = "flag INT, first_block BIGINT, deltas ARRAY<BIGINT>, read_counts ARRAY<BIGINT>"
LAYOUTS = ("flat", "packed")


class BadIndex(ValueError):
    """A stored index that cannot be used."""


@dataclass(frozen=True)
class Source:
    path: str
    size: int
    #: Milliseconds since the epoch; a rewrite within a second is noticed.
    mtime: int


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def source_of(spark: SparkSession, path: str) -> Source | None:
    """Size and latest modification of a file or a directory's files; None if there is none."""
    fs, p = _path(spark, path)
    if not fs.exists(p):
        return None
    size, mtime, files = 0, 0, fs.listFiles(p, True)
    while files.hasNext():
        status = files.next()
        size, mtime = size + status.getLen(), max(mtime, status.getModificationTime())
    return Source(path, size, mtime)


class Catalog:
    """Indexes below one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        """The one rule: the name, or the last part of a source's path."""
        return f"{self.root}/{name.rstrip('/').rsplit('/', 1)[-1]}"

    def save(self, name: str, index: DataFrame, source: str | None = None, layout: str = "flat", build_time_ms: int | None = None) -> None:
        """Store the index; its build time, unless given, is that of writing it, which is when a lazy index is built."""
        if layout not in LAYOUTS:
            raise ValueError(f"unknown layout: {layout!r}")
        seen = source_of(self.spark, source) if source else None
        created = int(time.time() * 1000)
        data = f"data-{created}"
        began = time.perf_counter()
        rows = index.select(F.col("flag").cast("int"), F.col("block_id").cast("bigint"), F.col("read_count").cast("bigint"))
        stored = pack(rows, range_width(rows)) if layout == "packed" else rows.repartitionByRange("flag", "block_id").sortWithinPartitions("flag", "block_id")
        stored.write.option("compression", "zstd").parquet(f"{self.path(name)}/{data}")
        took = int((time.perf_counter() - began) * 1000)
        ratio = compression_stats(self._data(name, layout, data)).first()["compression_ratio"] if layout == "packed" else 1.0
        old = self.manifest(name, missing_ok=True)
        row = {"version": VERSION, "created": created // 1000, "source_path": source, "source_size": seen.size if seen else None, "source_mtime": seen.mtime if seen else None}
        row |= {"layout": layout, "build_time_ms": took if build_time_ms is None else build_time_ms, "compression_ratio": float(ratio), "data": data}
        self.spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path(name)}/manifest")
        if old and old["data"] != data:
            fs, p = _path(self.spark, f"{self.path(name)}/{old['data']}")
            fs.delete(p, True)

    def manifest(self, name: str, missing_ok: bool = False) -> Row | None:
        fs, p = _path(self.spark, f"{self.path(name)}/manifest/_SUCCESS")
        if not fs.exists(p):
            if missing_ok:
                return None
            raise BadIndex(f"no index {name!r}")
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path(name)}/manifest").first()

    def _data(self, name: str, layout: str, data: str) -> DataFrame:
        read = self.spark.read.schema(PACKED if layout == "packed" else SCHEMA).parquet(f"{self.path(name)}/{data}")
        return unpack(read) if layout == "packed" else read

    def load(self, name: str) -> DataFrame:
        """The index, whatever its layout; an error for a missing one or one of a later version."""
        m = self.manifest(name)
        if m is None or m["version"] is None or m["version"] > VERSION or m["layout"] not in LAYOUTS:
            raise BadIndex(f"index {name!r} has a format that this version does not read")
        return self._data(name, m["layout"], m["data"])

    def is_stale(self, name: str) -> bool:
        m = self.manifest(name)
        if m["source_path"] is None:
            return False
        now = source_of(self.spark, m["source_path"])
        return now is None or now.size != m["source_size"] or now.mtime > m["source_mtime"]

    def load_or_build(self, name: str, source: str, build: Callable[[], DataFrame], force: bool = False, layout: str = "flat") -> DataFrame:
        """The stored index if it can be used and is fresh; else a new one, which is stored (a failure to do so is a warning)."""
        if not force:
            try:
                if not self.is_stale(name):
                    return self.load(name)
            except BadIndex:
                pass
        index = build()
        try:
            self.save(name, index, source, layout)
        except Exception as e:  # noqa: BLE001
            warnings.warn(f"index {name!r} was not stored: {e}", stacklevel=2)
            return index
        return self.load(name)

    def clear(self, name: str) -> bool:
        """Delete the index; was there one?"""
        fs, p = _path(self.spark, self.path(name))
        return bool(fs.delete(p, True))

    def info(self, name: str) -> DataFrame:
        """The manifest with age and freshness."""
        m = self.manifest(name)
        row = self.spark.createDataFrame([m.asDict() | {"is_stale": self.is_stale(name)}], MANIFEST + ", is_stale BOOLEAN")
        return row.withColumn("age", age("created", F.unix_timestamp()))


