"""Records as SAM text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lines(records: DataFrame, names: tuple[str, ...] = ()) -> DataFrame:
    """One text line per record, in the order of the input; ``names`` are the references' of the header."""
    refs = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    name = lambda tid: F.when((F.col(tid) >= 0) & (F.col(tid) < len(names)), F.try_element_at(refs, F.col(tid) + 1)).otherwise("*")
    star = lambda c: F.when(F.length(c) > 0, c).otherwise("*")
    cigar = F.concat_ws("", F.transform("cigar", lambda x: F.concat(x["len"].cast("string"), x["op"])))
    mate = F.when((F.col("mtid") == F.col("tid")) & (F.col("mtid") >= 0), "=").otherwise(name("mtid"))
    fields: list[Column] = [
        star(F.col("qname")), F.col("flag"), name("tid"), F.col("pos") + 1, F.col("mapq"), star(cigar), mate, F.col("mpos") + 1, F.col("insert_size"), star(F.col("seq")), _quality()
    ]
    return records.select(F.concat_ws("\t", *[f.cast("string") for f in fields]).alias("value"))


def _quality() -> Column:
    """Scores as printable letters; ``*`` without any (255 or none)."""
    digits = F.hex("qual")
    letters = F.transform(F.sequence(F.lit(1), F.length(digits), F.lit(2)), lambda i: F.char(F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("int") + 33))
    return F.when((F.length("qual") == 0) | F.col("qual").isNull() | digits.startswith("FF"), "*").otherwise(F.array_join(letters, ""))


def write(records: DataFrame, path: str, header: str = "", names: tuple[str, ...] = ()) -> None:
    """Text files whose first, in name order, holds the header."""
    body = lines(records, names)
    if header:
        head = records.sparkSession.createDataFrame([(x,) for x in header.rstrip("\n").split("\n")], "value string").coalesce(1)
        body = head.unionAll(body)
    body.write.text(path)
