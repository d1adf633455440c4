"""Reports: frequent flags, bits, and the analysis of benchmark results."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.flags import flag_bits, hex_flag, labels
from .index import flag_summary

#: Columns of stored benchmark results and of resource samples.
RESULTS = "threads INT, strategy STRING, time_ms BIGINT, peak_memory_mb DOUBLE, avg_memory_mb DOUBLE, peak_cpu_percent DOUBLE, avg_cpu_percent DOUBLE, index_size_mb DOUBLE, samples INT"
SAMPLES = "threads INT, strategy STRING, timestamp_ms BIGINT, memory_mb DOUBLE, cpu_percent DOUBLE"


def top_flags(index: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most frequent flags with their share of all records and their labels; ties by flag."""
    flags = flag_summary(index)  # 65,536 rows at most, so a window over all of them is bounded
    top = flags.withColumn("total_records", F.sum("total_reads").over(Window.partitionBy())).orderBy(F.desc("total_reads"), "flag").limit(n)
    share = F.when(F.col("total_records") > 0, F.col("total_reads") * 100.0 / F.col("total_records")).otherwise(0.0)
    return top.select("flag", hex_flag("flag").alias("hex"), "total_reads", share.alias("percentage"), labels("flag").alias("labels"))


def bit_totals(index: DataFrame) -> DataFrame:
    """Records and flags per named bit: the flags, a few hundred rows, joined with the 12 bits they hold."""
    bits = F.broadcast(flag_bits(index.sparkSession))  # 12 rows
    hit = F.col("flag").bitwiseAND(F.col("bit")) != 0
    return flag_summary(index).join(bits, hit).groupBy("bit", "label").agg(F.sum("total_reads").alias("reads"), F.count("*").alias("flags"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Results from CSV, with the time in seconds beside milliseconds."""
    return spark.read.csv(path, header=True, schema=RESULTS).withColumn("time_s", F.col("time_ms") / 1000.0)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def sample_stats(results: DataFrame) -> DataFrame:
    """Per strategy and threads: mean, range and deviations of the time, mean peak memory and CPU."""
    w = Window.partitionBy("strategy", "threads")
    near = results.withColumn("off", F.abs(F.col("peak_memory_mb") - F.avg("peak_memory_mb").over(w)))
    return near.groupBy("strategy", "threads").agg(
        F.avg("time_ms").alias("mean_ms"),
        F.min("time_ms").alias("min_ms"),
        F.max("time_ms").alias("max_ms"),
        F.stddev_pop("time_ms").alias("stddev_ms"),
        F.avg("peak_memory_mb").alias("mean_peak_memory_mb"),
        F.avg("off").alias("peak_memory_deviation_mb"),
        F.avg("avg_cpu_percent").alias("mean_cpu_percent"),
    )


def resource_stats(samples: DataFrame) -> DataFrame:
    """Peak and mean memory and CPU per run; 0 without samples."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return samples.groupBy("strategy", "threads").agg(
        zero(F.max("memory_mb")).alias("peak_memory_mb"), zero(F.avg("memory_mb")).alias("avg_memory_mb"), zero(F.max("cpu_percent")).alias("peak_cpu_percent"), zero(F.avg("cpu_percent")).alias("avg_cpu_percent")
    )


def best(results: DataFrame) -> DataFrame:
    """One row: the fastest, the leanest and the busiest strategy; ties by name."""
    return results.agg(
        F.min_by("strategy", F.struct("time_ms", "strategy", "threads")).alias("fastest"),
        F.min_by("strategy", F.struct("peak_memory_mb", "strategy", "threads")).alias("most_memory_efficient"),
        F.max_by("strategy", F.struct("avg_cpu_percent", "strategy", "threads")).alias("best_cpu_utilization"),
    )


def best_per_threads(results: DataFrame) -> DataFrame:
    return results.groupBy("threads").agg(F.min_by("strategy", F.struct("time_ms", "strategy")).alias("strategy"), F.min("time_ms").alias("time_ms"))


def speedups(results: DataFrame, baseline: str) -> DataFrame:
    """Each run against the baseline strategy's fastest; 2.0 is twice as fast."""
    base = results.filter(F.col("strategy") == baseline).agg(F.min("time_ms").alias("base_ms"))
    return results.crossJoin(base).select("strategy", "threads", (F.col("base_ms") / F.col("time_ms")).alias("speedup"))  # times one row


def scaling(results: DataFrame) -> DataFrame:
    """The lines of a scaling plot: per strategy, by threads."""
    return results.select("strategy", "threads", "time_ms").orderBy("strategy", "threads")


def rescaled(df: DataFrame, value: str, by: list[str], out: str = "scaled") -> DataFrame:
    """``value`` from 0 to 1 within each group; 0 where the group has one value."""
    w = Window.partitionBy(*by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn(out, F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(0.0))


def thread_counts(spec: str, most: int | None = None) -> list[int]:
    """``max``, ``auto`` (0) and numbers, sorted and distinct; what is neither is skipped; ``max`` if nothing is left."""
    most = most or os.cpu_count() or 1
    out = set()
    for part in (x.strip() for x in spec.split(",")):
        if part == "max":
            out.add(most)
        elif part == "auto":
            out.add(0)
        elif re.fullmatch(r"\+?[0-9]+", part):
            out.add(int(part))
    return sorted(out or {most})


def scraped_count(output: str) -> int:
    """A count from a tool's output: after ``Matching reads:``, the whole output, or its last numeric line; else 0."""
    if found := re.search(r"Matching reads:[^\S\n]*\+?([0-9]+)[^\S\n]*$", output, re.M):
        return int(found[1])
    numeric = re.findall(r"^[^\S\n]*\+?([0-9]+)[^\S\n]*$", output, re.M)
    return int(numeric[-1]) if numeric else 0
