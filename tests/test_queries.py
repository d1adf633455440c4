"""Every engine query against its SQL, and the golden numbers of the line items."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from bitquarry import checks, queries
from bitquarry.functions.flags import Mask
from bitquarry.operators import index, query
from bitquarry.sources.records import lineitem_records

QUERIES, ORACLE = queries.QUERIES | checks.QUERIES, queries.ORACLE | checks.ORACLE
DIR = "/root/testdata/sf0.001"


def normal(rows):
    plain = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v
    return sorted(repr([plain(v) for v in r]) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in sorted(os.listdir(DIR)):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, con, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE[name]})").fetchall()
    assert normal(map(tuple, df.select(*columns).collect())) == normal(want)


def test_golden(spark):
    r = lineitem_records(spark.read.parquet(f"{DIR}/lineitem.parquet"))
    i = index.build(r).cache()
    assert (i.count(), i.select("flag").distinct().count(), i.select("block_id").distinct().count()) == (1963, 299, 24)
    for mask, n in (((4, 0), 635), ((4, 0x400), 571), ((0, 4), 5365), ((1, 0), 5082), ((3, 0), 1488), ((0x900, 0), 10)):
        assert query.count(i, Mask(*mask)).first()[0] == n
    c = index.compression_stats(i).first()
    assert (c["original_size"], c["compressed_size"]) == (31408, 19760)


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
