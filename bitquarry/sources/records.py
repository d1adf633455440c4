"""Adapters from any table to records: ``block_id BIGINT, flag INT`` and a payload."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Order keys that share a block of the line items.
KEYS_PER_BLOCK = 64


def records(df: DataFrame, block: Column, bits: Mapping[int, Column]) -> DataFrame:
    """The table with a block and a flag of the bits whose predicate holds (null counts as not)."""
    flag = sum((F.when(test, F.lit(bit)).otherwise(F.lit(0)) for bit, test in bits.items()), F.lit(0))
    kept = [c for c in df.columns if c.lower() not in ("block_id", "flag")]
    return df.select(block.cast("bigint").alias("block_id"), flag.cast("int").alias("flag"), *kept)


def lineitem_bits() -> dict[int, Column]:
    """Predicates on line items, one per named bit."""
    c = F.col
    return {
        0x001: c("l_linenumber") <= 6,
        0x002: (c("l_returnflag") == "N") & (c("l_linenumber") <= 5),
        0x004: c("l_quantity") <= 5,
        0x008: c("l_suppkey") % 16 == 0,
        0x010: c("l_linestatus") == "F",
        0x020: c("l_partkey") % 2 == 1,
        0x040: c("l_linenumber") % 2 == 1,
        0x080: c("l_linenumber") % 2 == 0,
        0x100: c("l_discount") > 0.095,
        0x200: c("l_tax") > 0.075,
        0x400: (c("l_returnflag") == "R") & (c("l_linenumber") <= 2),
        0x800: c("l_quantity") == 50,
    }


def lineitem_records(lineitem: DataFrame) -> DataFrame:
    """Line items as records; a block holds the items of 64 neighbouring order keys."""
    return records(lineitem, F.expr(f"l_orderkey div {KEYS_PER_BLOCK}"), lineitem_bits())
