"""A corpus from raw documents to piece ids, in five stages.

Each stage is a function of (spark, docs, sf_dir); its result is written as
Parquet and read again as the next one's ``docs``.  All but the last return the
columns of ``documents``.  ``run`` deletes each stage's table once the next one
is written; the last one's is what it returns.

Results for odd input, by stage.  A null or empty text is of grade 0, stays in
near-dedup (it links with nothing), has no personal data (a null stays null,
and so does its ``n_chars``), is mixed at no cost and has no ids.  A null id
stays in every stage and is no copy of anything.  A null source is a source of
its own.  Rows that repeat as a whole, or as texts, are one group, of which the
row least by id, then by a digest of its text, stays; different texts under one id are
different documents.  Very long texts are read whole.  Empty tables give an
empty result, and without labels of both kinds toxicity rejects nothing.
Further columns of ``docs``, whatever their names (``__bq_`` is reserved), stay
as they are up to the last stage, which returns ``doc_id``, ``source`` and ``ids``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitquarry.llm import cpsjoin, mixing, pieces, pii, toxicity
from bitquarry.llm.common import fresh_path, remove, table

PIECES_FILE = public_tokenizers.path("piece_bpe_32k.model")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of severity grade 0 stay."""
    return toxicity.accept(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with a similarity of 0.8 on five-word shingles stays."""
    return cpsjoin.keep_first(docs, n=5, percent=80)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes a tag; ``n_chars`` follows."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by temperature, none read more than twice and every document at least once."""
    return mixing.mix(docs, mixing.Target(repeats=2.0, budget=None))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of every text."""
    return pieces.encode(docs.select("doc_id", "source", "text"), PIECES_FILE).select("doc_id", "source", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("pii", redact_pii),
    ("mixing", mix_sources),
    ("pieces", encode),
]

#: SQL cannot express the trained and the iterative stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages on the ``documents`` of ``sf_dir``."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
