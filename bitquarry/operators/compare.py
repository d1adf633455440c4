"""Comparison of indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .index import flag_summary, total_records


def mismatches(a: DataFrame, b: DataFrame) -> DataFrame:
    """Flags whose records differ in number, with null where a side has none."""
    left, right = (flag_summary(x).withColumnRenamed("total_reads", name) for x, name in ((a, "left_reads"), (b, "right_reads")))
    return left.join(right, "flag", "full_outer").filter(~F.col("left_reads").eqNullSafe(F.col("right_reads")))


def is_equivalent(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: are all flags' counts equal, and so the totals?  Blocks do not matter.  One aggregate over both sides."""
    sides = a.select("flag", F.col("read_count").alias("l"), F.lit(0).cast("bigint").alias("r")).unionAll(b.select("flag", F.lit(0).cast("bigint"), F.col("read_count")))
    per = sides.groupBy("flag").agg((F.sum("l") == F.sum("r")).alias("same"))
    return per.agg(F.coalesce(F.bool_and("same"), F.lit(True)).alias("equivalent"))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: blocks of either side and of both, in one aggregate over block ids."""
    sides = a.select("block_id", F.lit(1).alias("side")).unionAll(b.select("block_id", F.lit(2).alias("side")))
    per = sides.groupBy("block_id").agg(F.max((F.col("side") == 1).cast("int")).alias("l"), F.max((F.col("side") == 2).cast("int")).alias("r"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    sums = per.agg(zero(F.col("l")).alias("left_blocks"), zero(F.col("r")).alias("right_blocks"), zero(F.col("l") * F.col("r")).alias("common_blocks"))
    most = F.greatest("left_blocks", "right_blocks")
    return sums.withColumn("overlap_percent", F.when(most > 0, F.col("common_blocks") * 100.0 / most).otherwise(100.0))


def analyze(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: overlap and mismatch figures and whether they pass.

    Blocks pass from 95 % on, bins without a mismatch; overall the totals must
    be equal, blocks pass, and at most a twentieth of the left flags mismatch.
    """
    counts = mismatches(a, b).agg(F.count("*").alias("mismatched_bins"))
    flags = flag_summary(a).agg(F.count("*").alias("left_flags"))
    totals = total_records(a).select(F.col("total_records").alias("left_total")).crossJoin(total_records(b).select(F.col("total_records").alias("right_total")))
    row = overlap(a, b).crossJoin(counts).crossJoin(flags).crossJoin(totals)  # one row each
    fine = (F.col("left_total") == F.col("right_total")) & (F.col("overlap_percent") >= 95) & (F.col("mismatched_bins") <= F.floor(F.col("left_flags") / 20))
    return row.select("*", (F.col("overlap_percent") >= 95).alias("blocks_pass"), (F.col("mismatched_bins") == 0).alias("bins_pass"), fine.alias("overall_pass"))


def counts_agree(counts: DataFrame, value: str = "record_count") -> DataFrame:
    """One row: ``Passed`` if all tools count the same, ``Failed`` if not, ``Skipped`` for fewer than two."""
    state = F.when(F.count(value) < 2, "Skipped").when(F.min(value) == F.max(value), "Passed").otherwise("Failed")
    return counts.agg(state.alias("outcome"))
