from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents of (doc_id, text) pairs, in three partitions."""

    def docs(rows, source=lambda i: f"s{(i or 0) % 3}"):
        full = [(i, t, "en", source(i), None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(full, DOCS).repartition(3)

    return docs


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with names that operators use."""
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, "a row without an id but with several words"), (4, "short"), (5, "é ü 日本 𝔘 " * 3)]
    rows += [(6, "the same row twice is here"), (6, "the same row twice is here"), (6, "another text under one id"), (7, "word " * 30000), (8, "x" * 50000)]
    from pyspark.sql import functions as F

    extra = ("ids", "start", "end", "key", "n_tokens", "copies", "removed", "severity", "grade", "cluster", "component", "id", "rep", "_id", "mix_key", "label")
    return make(rows).withColumns({c: F.lit("extra") for c in extra})


@pytest.fixture(scope="session")
def empty(make, spark):
    return spark.createDataFrame([], DOCS)
