"""Substring dedup by hashing text units: the earliest occurrence stays, the others go.

Units are lines, paragraphs (runs of lines without an empty one) or sentences
(lines cut after ``.``, ``!`` or ``?`` before a space), which also meet
passages pasted into the middle of a line.  A unit is normalised (lower case,
white space runs as one space) and hashed to 128 bits; digests are grouped over
the whole corpus with the least ``(doc_id, unit)`` as the earliest occurrence.
Units of fewer than ``min_words`` words are left alone.  Kind ``all`` takes
lines and paragraphs of any length and sentences of at least ``min_words``
words, each span once and all in one pool, so a line that stands as a sentence
elsewhere meets it; spans of it may lie within others, and ``remove`` cuts
their union.  Offsets count code points of the original text, ends are
exclusive.

Texts are cut and hashed once, into a table of the shared folder.  Digests are
aggregated before they are shuffled, so a line of a third of all documents is
one row per task.  Only digests that repeat are joined back: those of more than
one in ``HOT`` of all units, at most so many, by broadcast, all others by a
shuffle of the units that a bit table of them lets pass, so no digest is a hot key.

Results for odd input: a null or empty text has no units; a null ``doc_id``
ranks last; rows that repeat an id are ranked by a digest of their texts, and
each loses its own units alone; rows that repeat as a whole are one document in
rank, so a unit at the same place in both is one occurrence and stays in both;
an empty table gives an empty result.  ``duplicates`` returns its own columns
alone, ``remove`` keeps the input's columns and replaces ``text`` and ``removed``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, fresh_path, passing, small_batches, text_or_empty

#: Where a unit ends.
CUTS = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n(?:[^\S\n]*\n)+"), "sentence": re.compile(r"\n|[.!?](?= )")}
#: Stands for a null id, after all others.
LAST = (1 << 63) - 1
HOT = 4096

_UNITS = "doc_id long, own long, unit long, start long, end long, h1 long, h2 long, place decimal(38,0)"


def units(text: str, kind: str) -> list[tuple[int, int]]:
    """Start and end of each unit, without white space at its ends; empty ones too."""
    ends = [m.end() for m in CUTS[kind].finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    out, at = [], 0
    for end in ends:
        piece = text[at:end]
        low = at + len(piece) - len(piece.lstrip())
        out.append((low, max(low, at + len(piece.rstrip()))))
        at = end
    return out


def _numbered(text: str, kind: str) -> list[tuple[int, int, bool]]:
    """Start and end of each unit, and whether the least number of words holds for it."""
    if kind != "all":
        return [(low, high, True) for low, high in units(text, kind)]
    whole = {*units(text, "line"), *units(text, "paragraph")}
    spans = sorted(whole.union(units(text, "sentence")), key=lambda s: (s[0], -s[1]))
    return [(low, high, (low, high) not in whole) for low, high in spans]


def _places(doc: np.ndarray, own: np.ndarray, unit: np.ndarray) -> pa.Array:
    """The order of (id, a text's digest, unit) as one number of 128 bits, which Spark aggregates without sorting."""
    rest = ((own.astype(np.uint64) >> np.uint64(34)) << np.uint64(32)) | unit.astype(np.uint64)
    words = np.empty((len(doc), 2), np.uint64)
    words[:, 0] = (doc.astype(np.uint64) << np.uint64(62)) | rest
    words[:, 1] = (doc >> 2).astype(np.uint64)
    return pa.Array.from_buffers(pa.decimal128(38, 0), len(doc), [None, pa.py_buffer(words.tobytes())])


def _hashed(batches: Iterator[pa.RecordBatch], kind: str, min_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, owns, numbers, starts, ends, digests = [], [], [], [], [], []
        for doc, own, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            text = value.as_py()
            if not text:
                continue
            for number, (low, high, floor) in enumerate(_numbered(text, kind)):
                words = text[low:high].lower().split()
                if len(words) >= (min_words if floor else 1):
                    docs.append(doc)
                    owns.append(own)
                    numbers.append(number)
                    starts.append(low)
                    ends.append(high)
                    digests.append(xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass")))
        h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        columns = [np.array(x, np.int64) for x in (docs, owns, numbers, starts, ends)] + [np.ascontiguousarray(h[:, i]) for i in (0, 1)]
        names = ["doc_id", "own", "unit", "start", "end", "h1", "h2", "place"]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), _places(*columns[:3])], names=names)


def _repeated(docs: DataFrame, kind: str, min_words: int) -> DataFrame:
    """Units that are not the earliest of their digest, with ``own``, the digest of the row's text."""
    spark = docs.sparkSession
    small_batches(spark)
    text = text_or_empty()
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64(text).alias("own"), text.alias("text"))
    path = fresh_path(spark, "units")
    rows.mapInArrow(lambda it: _hashed(it, kind, min_words), _UNITS).write.parquet(path)
    found = spark.read.parquet(path)
    digest = ["h1", "h2"]
    first = found.groupBy(*digest).agg(F.min("place").alias("low"), F.max("place").alias("high"), F.count("*").alias("n")).filter("low <> high")
    first = checkpoint(first.select(*digest, "low", "n"))
    rest = F.pmod("low", F.lit(1 << 62).cast("decimal(38,0)"))
    place = first.select("*", ((F.col("low") - rest) / F.lit(1 << 62).cast("decimal(38,0)")).cast("long").alias("first_doc_id"), rest.cast("long").bitwiseAND((1 << 32) - 1).alias("first_unit"))
    few = F.broadcast(first.filter(F.col("n") > max(1, found.count() // HOT)).select(*digest))  # at most HOT rows
    place = place.drop("n")
    again = passing(found, first, digest)
    cold = again.join(few, digest, "left_anti").join(place, digest)
    return cold.unionByName(found.join(F.broadcast(place.join(few, digest, "left_semi")), digest)).filter("place <> low")


def duplicates(docs: DataFrame, kind: str = "sentence", min_words: int = 6) -> DataFrame:
    """One row per unit to remove: ``doc_id, unit, start, end, first_doc_id, first_unit``."""
    whole = lambda c: F.when(F.col(c) != LAST, F.col(c)).alias(c)
    return _repeated(docs, kind, min_words).select(whole("doc_id"), "unit", "start", "end", whole("first_doc_id"), "first_unit")


def remove(docs: DataFrame, kind: str = "sentence", min_words: int = 6) -> DataFrame:
    """The documents without repeated units; ``removed`` has the (start, end) of each in the original text."""
    found = _repeated(docs, kind, min_words).groupBy(F.col("doc_id").alias("__bq_id"), F.col("own").alias("__bq_own"))
    spans = found.agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("removed"))
    rows = docs.drop("removed").withColumns({"__bq_of": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "__bq_text": F.xxhash64(text_or_empty())})
    joined = rows.join(spans, (F.col("__bq_of") == F.col("__bq_id")) & (F.col("__bq_text") == F.col("__bq_own")), "left").drop("__bq_id", "__bq_own", "__bq_of", "__bq_text")

    @F.pandas_udf("string")
    def cut(texts, removed):  # noqa: ANN001, ANN202
        import pandas as pd

        out = []
        for text, gone in zip(texts, removed, strict=True):
            if text is None or gone is None or not len(gone):
                out.append(text)
                continue
            kept, at = [], 0
            for span in gone:
                if span["end"] > at:
                    kept.append(text[at : span["start"]])
                    at = span["end"]
            out.append("".join([*kept, text[at:]]))
        return pd.Series(out, dtype=object)

    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return joined.withColumn("removed", F.coalesce("removed", none)).withColumn("text", cut(F.col("text").cast("string"), "removed"))
