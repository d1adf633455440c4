"""What several operators of this subpackage share.

Columns whose names begin with ``__bq_`` are the operators' own; an input may
have any others.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from typing import Any, TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is the session's ``spark.checkpoint.dir``, else the context's
    checkpoint folder; a temporary folder is set only where neither is and the
    master is local (tests), as other machines would not see it.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="bitquarry-"))
        found = sc.getCheckpointDir()
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path below the shared folder, by Hadoop's file systems."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)  # noqa: SLF001


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage into the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Lower the session's Arrow batches from Spark's default of 64 MB, for rows that hold whole blocks or texts.

    A session that sets another size keeps it.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if str(spark.conf.get(key)).rstrip("b") == str(64 << 20):
        spark.conf.set(key, size)


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The batches again, cut so that rows with equal ``key``, which follow each other, stay together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy()
        if held and k[-1] == held[-1].column(key)[0].as_py() and k[0] == k[-1]:
            held.append(batch)
            continue
        cut = int(np.flatnonzero(k != k[-1])[-1]) + 1 if k[0] != k[-1] else 0
        if cut or held:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)] if cut else held)
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


#: Bits of the table in ``passing``; its rows hold 64 of them.
BITS = 26


def passing(rows: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """The rows whose ``on`` may be among those of ``wanted``, and few others.

    A table of bits, at most ``2**BITS / 64`` rows, is broadcast, so what does
    not pass is never shuffled; where ``wanted`` is so large that it sets most bits,
    all rows pass.  An exact join must follow.
    """
    bit = F.pmod(F.xxhash64(*on), F.lit(1 << BITS))
    word, mask = F.shiftright(bit, 6), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))
    table = wanted.select(word.alias("__bq_word"), mask.alias("__bq_bits")).groupBy("__bq_word").agg(F.bit_or("__bq_bits").alias("__bq_bits"))
    marked = rows.withColumn("__bq_word", word).join(F.broadcast(table), "__bq_word")
    return marked.filter(F.col("__bq_bits").bitwiseAND(mask) != 0).select(*rows.columns)


_STATE: dict[Hashable, Any] = {}


def worker_state(key: Hashable, make: Callable[[], T]) -> T:
    """What an operator keeps in a worker process between its tasks: word memories, models.

    There is one such thing at a time: another operator's call drops it, so a
    long-lived worker of several stages does not collect them all.
    """
    if key not in _STATE:
        _STATE.clear()
        give_back()
        _STATE[key] = make()
    return _STATE[key]


def give_back() -> None:
    """Return freed memory of this process to the system, as far as the allocators can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not the GNU C library
        ctypes.CDLL(None).malloc_trim(0)


def tidy(batches: Iterator[T]) -> Iterator[T]:
    """The batches; when they are over, the worker, which waits for its next task, gives freed memory back."""
    try:
        yield from batches
    finally:
        give_back()


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
