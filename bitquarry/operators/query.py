"""Mask queries on an index and retrieval of records through it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.flags import CANNED, Mask

#: Records that ``for_each_batch`` hands over together.
BATCH = 1000


def count(index: DataFrame, mask: Mask) -> DataFrame:
    """Matching records, from the index alone; 0 if none."""
    return mask.apply(index).agg(F.coalesce(F.sum("read_count"), F.lit(0)).alias("matching_reads"))


def scan_count(records: DataFrame, mask: Mask) -> DataFrame:
    """Matching records, counted without an index."""
    return mask.apply(records).agg(F.count("*").alias("matching_reads"))


def blocks_for(index: DataFrame, mask: Mask) -> DataFrame:
    """The blocks with at least one matching record."""
    return mask.apply(index).select("block_id").distinct()


def exact_flag(index: DataFrame, flag: int) -> DataFrame:
    """The blocks and counts of one flag."""
    return index.filter(F.col("flag") == flag)


def canned_counts(index: DataFrame) -> DataFrame:
    """Matching records of the canned requests, in one pass over the index."""
    sums = [F.coalesce(F.sum(F.when(m.column(), F.col("read_count"))), F.lit(0)).alias(name) for name, m in CANNED.items()]
    names = ", ".join(f"'{n}', `{n}`" for n in CANNED)
    return index.agg(*sums).selectExpr(f"stack({len(CANNED)}, {names}) as (request, matching_reads)")


def result(index: DataFrame, mask: Mask) -> DataFrame:
    """One row: count, sorted blocks, their number, and the matching flags."""
    got = mask.apply(index).agg(
        F.coalesce(F.sum("read_count"), F.lit(0)).alias("matching_reads"), F.array_sort(F.collect_set("block_id")).alias("blocks"), F.array_sort(F.collect_set("flag")).alias("matching_flags")
    )
    return got.select("matching_reads", "blocks", F.size("blocks").cast("bigint").alias("blocks_to_scan"), "matching_flags")


def flag_preview(result_row: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` matching flags in hexadecimal, and how many more there are."""
    shown = F.array_join(F.transform(F.slice("matching_flags", 1, n), lambda f: F.format_string("0x%03x", f)), ", ")
    more = F.size("matching_flags") - n
    return result_row.select(F.concat(shown, F.when(more > 0, F.format_string(" ... and %d more", more)).otherwise("")).alias("preview"))


def efficiency(index: DataFrame, mask: Mask) -> DataFrame:
    """One row: selectivity and what a retrieval would read, with advice."""
    hit = mask.column()
    got = index.agg(
        F.coalesce(F.sum(F.when(hit, F.col("read_count"))), F.lit(0)).alias("matching_reads"),
        F.coalesce(F.sum("read_count"), F.lit(0)).alias("total_reads"),
        F.countDistinct(F.when(hit, F.col("block_id"))).alias("blocks_to_scan"),
        F.countDistinct(F.when(hit, F.col("flag"))).alias("flags_matched"),
    )
    share = F.when(F.col("total_reads") > 0, F.col("matching_reads") / F.col("total_reads")).otherwise(0.0)
    advice = F.when(share > 0.5, "scan the whole file").when(F.col("blocks_to_scan") > 1000, "may be slow").otherwise("efficient")
    return got.select("*", share.alias("selectivity"), F.col("blocks_to_scan").alias("estimated_io_operations"), advice.alias("advice"))


def view(records: DataFrame, index: DataFrame, mask: Mask) -> DataFrame:
    """Matching records of a table, by the flags that the index says occur.

    All matching records lie in matching blocks, so on a table that is not
    stored by block a join with these would read as much and sort more.
    ``plans.skipping`` prunes tables that are, and the BAM source takes blocks.
    """
    return records if mask.is_all else with_flag_list(records, index, mask)


def view_direct(records: DataFrame, mask: Mask) -> DataFrame:
    """Matching records by a scan."""
    return mask.apply(records)


def with_flag_list(records: DataFrame, index: DataFrame, mask: Mask, most: int = 4096) -> DataFrame:
    """The mask as ``flag IN (...)`` of the flags that occur, which Parquet readers can push down.

    At most ``most`` flags are listed; beyond, the bit test does the same.
    """
    found = mask.apply(index).select("flag").distinct().orderBy("flag").limit(most + 1).collect()
    if len(found) > most:
        return mask.apply(records)
    return records.filter(F.col("flag").isin([r["flag"] for r in found])) if found else records.filter(F.lit(False))


def by_block(records: DataFrame, mask: Mask) -> DataFrame:
    """Per block with matching records: their number.  The records of one block are ``records.filter(block_id = ...)``."""
    return mask.apply(records).groupBy("block_id").agg(F.count("*").alias("count"))


def block_results(records: DataFrame, mask: Mask, columns: list[str]) -> DataFrame:
    """Per block its matching records as an array; a block is a bounded unit of the input."""
    packed = F.collect_list(F.struct(*columns)).alias("records")
    return mask.apply(records).groupBy("block_id").agg(packed, F.count("*").alias("count")).withColumn("is_empty", F.col("count") == 0)


def iterate(records: DataFrame, mask: Mask) -> Iterator:
    """Pull matching records one by one, a partition at a time."""
    return mask.apply(records).toLocalIterator()


@dataclass(frozen=True)
class Progress:
    done: int
    #: From the index: how many there will be.
    total: int

    @property
    def share(self) -> float:
        return self.done / self.total if self.total else 1.0


def iterate_with_progress(records: DataFrame, index: DataFrame, mask: Mask) -> Iterator[tuple[object, Progress]]:
    """Matching records one by one, each with how far the pull is; the total is known before the first record."""
    total = count(index, mask).first()[0]
    for done, row in enumerate(iterate(records, mask), 1):
        yield row, Progress(done, total)


def map_batches(records: DataFrame, mask: Mask, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str, size: int = BATCH) -> DataFrame:
    """``f`` on batches of at most ``size`` matching records, on the executors; the remainder is a batch too."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        n = 0
        for part in parts:
            while len(part):
                take, part = part.iloc[: size - n], part.iloc[size - n :]
                held.append(take)
                n += len(take)
                if n == size:
                    yield f(pd.concat(held, ignore_index=True))
                    held, n = [], 0
        if held:
            yield f(pd.concat(held, ignore_index=True))

    return mask.apply(records).mapInPandas(run, schema)


def for_each_batch(records: DataFrame, mask: Mask, f: Callable[[pd.DataFrame], object], size: int = BATCH) -> int:
    """Call ``f`` on the driver with batches of matching records; how many records there were."""
    rows, n = [], 0
    for row in iterate(records, mask):
        rows.append(row.asDict())
        if len(rows) == size:
            f(pd.DataFrame(rows))
            n, rows = n + len(rows), []
    if rows:
        f(pd.DataFrame(rows))
    return n + len(rows)


def page(df: DataFrame, number: int, size: int = 20, order: str = "flag") -> DataFrame:
    """The page of that number from 0 on; size 0 gives everything."""
    ordered = df.orderBy(order)
    return ordered.offset(number * size).limit(size) if size else ordered
