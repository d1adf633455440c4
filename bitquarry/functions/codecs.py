"""Delta and varint codecs over block ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Block ids to a range in ``delta_encode``.
WIDTH = 1 << 24


def varint_length(value: str | Column) -> Column:
    """Bytes of a non-negative long in seven-bit groups; 0 for null."""
    c = F.col(value) if isinstance(value, str) else value
    out = F.when(c.isNull(), F.lit(0))
    for n in range(1, 9):
        out = out.when(c < F.lit(1 << (7 * n)), F.lit(n))
    return out.otherwise(F.lit(9))


def varint_bytes(value: str | Column) -> Column:
    """The bytes of one non-negative long, as ``varint_encode`` gives them; null for null."""
    c = F.col(value) if isinstance(value, str) else value
    group = lambda k: F.call_function("shiftright", c, 7 * k).bitwiseAND(127)
    last = varint_length(c) - 1
    digits = F.transform(F.sequence(F.lit(0), last), lambda k: F.lpad(F.hex(F.when(k < last, group(k).bitwiseOR(128)).otherwise(group(k))), 2, "0"))
    return F.when(c.isNotNull(), F.unhex(F.array_join(digits, "")))


def varint_encode(values: list[int]) -> bytes:
    """Seven bits a byte, least significant first, the top bit on all but a value's last byte."""
    out = bytearray()
    for v in values:
        rest = v & (1 << 64) - 1
        while rest > 127:
            out.append(rest & 127 | 128)
            rest >>= 7
        out.append(rest)
    return bytes(out)


def varint_decode(data: bytes) -> list[int]:
    """The inverse; an error for a value cut off or of more than 64 bits."""
    out, value, shift = [], 0, 0
    for byte in data:
        if shift >= 64:
            raise ValueError("varint of more than 64 bits")
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            out.append(value & (1 << 64) - 1)
            value, shift = 0, 0
    if shift:
        raise ValueError("varint cut off")
    return out


def delta_encode(index: DataFrame, width: int = WIDTH) -> DataFrame:
    """Add ``delta``: the distance from the flag's previous block, null for its first.

    Windows hold one flag's blocks of one range of ``width`` ids; the last
    block before a range comes from a table with a row per flag and range.
    """
    ranged = index.withColumn("__range", F.floor(F.col("block_id") / F.lit(width)))
    last = ranged.groupBy("flag", "__range").agg(F.max("block_id").alias("__last"))
    before = last.select("flag", "__range", F.lag("__last").over(Window.partitionBy("flag").orderBy("__range")).alias("__before"))
    w = Window.partitionBy("flag", "__range").orderBy("block_id")
    joined = ranged.join(before, ["flag", "__range"])
    return joined.select(*index.columns, (F.col("block_id") - F.coalesce(F.lag("block_id").over(w), "__before")).alias("delta"))


def delta_decode(deltas: DataFrame) -> DataFrame:
    """``block_id`` again, of ``first_block``, ``delta`` and the place ``pos`` within a packed row (a flag and a first block); null for a null delta after the first place."""
    w = Window.partitionBy("flag", "first_block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    known = F.col("delta").isNotNull() | (F.col("pos") == 0)
    return deltas.withColumn("block_id", F.when(known, F.col("first_block") + F.sum(F.coalesce("delta", F.lit(0))).over(w)))


def array_deltas(values: str | Column) -> Column:
    """Differences of neighbours in an array of longs, without the first."""
    c = F.col(values) if isinstance(values, str) else values
    return F.when(F.size(c) < 2, F.array().cast("array<bigint>")).otherwise(F.zip_with(F.slice(c, 2, F.size(c) - 1), F.slice(c, 1, F.size(c) - 1), lambda a, b: a - b))
