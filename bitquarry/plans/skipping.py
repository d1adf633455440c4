"""Records stored for block skipping.

The table is partitioned by ``bucket``, a run of neighbouring blocks, and
sorted by flag and block within.  A retrieval asks the index which flags match:
their list, and the range of their blocks, are filters that Parquet takes to row
groups and pages.  The flags alone decide which records match; a join with the
matching buckets only prunes partitions at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.flags import Mask

#: Flags that are listed in a filter, at most.
LISTED = 4096


def bucket_of(blocks_per_bucket: int):  # noqa: ANN201
    return F.floor(F.col("block_id") / blocks_per_bucket).cast("bigint")


def write_records(records: DataFrame, path: str, blocks_per_bucket: int) -> None:
    """Store records by bucket; a bucket is one task's output file."""
    placed = records.withColumn("bucket", bucket_of(blocks_per_bucket))
    placed.repartition("bucket").sortWithinPartitions("bucket", "flag", "block_id").write.partitionBy("bucket").option("compression", "zstd").parquet(path)


def view(spark: SparkSession, path: str, index: DataFrame, mask: Mask, blocks_per_bucket: int) -> DataFrame:
    """Matching records of a table that ``write_records`` stored, pruned to the matching buckets at run time."""
    stored = spark.read.parquet(path)
    if mask.is_all:
        return stored.drop("bucket")
    buckets = mask.apply(index).select(bucket_of(blocks_per_bucket).alias("bucket")).distinct()
    return _listed(stored, index, mask, blocks_per_bucket).join(buckets, "bucket", "left_semi").drop("bucket")


def view_of(stored: DataFrame, index: DataFrame, mask: Mask, blocks_per_bucket: int) -> DataFrame:
    """The same of a table that is open already, by the range of matching buckets and without a join."""
    return stored.drop("bucket") if mask.is_all else _listed(stored, index, mask, blocks_per_bucket).drop("bucket")


def _listed(stored: DataFrame, index: DataFrame, mask: Mask, blocks_per_bucket: int) -> DataFrame:
    """The matching records, by their flags, within the range of blocks and buckets that hold them; one small query of the index."""
    flags, low, high = mask.apply(index).agg(F.collect_set("flag"), F.min("block_id"), F.max("block_id")).first()  # 65,536 flags at most
    if not flags:
        return stored.filter(F.lit(False))
    matching = stored.filter(F.col("flag").isin(sorted(flags))) if len(flags) <= LISTED else mask.apply(stored)
    return matching.filter(F.col("block_id").between(low, high) & F.col("bucket").between(low // blocks_per_bucket, high // blocks_per_bucket))
