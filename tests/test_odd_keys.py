"""Layouts against their SQL over order keys that are null, negative or too large for a double."""

from __future__ import annotations

import duckdb
import pytest

from bitquarry import checks, queries
from bitquarry.operators import index

QUERIES, ORACLE = queries.QUERIES | checks.QUERIES, queries.ORACLE | checks.ORACLE
KEYS = {
    "null": "CASE WHEN l_orderkey % 10 <> 3 THEN l_orderkey END",
    "negative": "l_orderkey - 700",
    "large": "l_orderkey + 1000000000000000007",
}


def order(row):
    return [(x is None, str(x)) for x in row]


@pytest.mark.parametrize("name", ["bins_arrays", "pack_arrays", "varint_roundtrip"])
@pytest.mark.parametrize("keys", KEYS)
def test_odd_keys(spark, tmp_path, name, keys):
    c = duckdb.connect()
    c.execute(f"COPY (SELECT * REPLACE ({KEYS[keys]} AS l_orderkey) FROM '/root/testdata/sf0.001/lineitem.parquet') TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    df = QUERIES[name](spark, str(tmp_path))
    columns = sorted(df.columns)
    want = c.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE[name]})").fetchall()
    assert sorted(map(tuple, df.select(*columns).collect()), key=order) == sorted(want, key=order)


@pytest.mark.parametrize("width", [None, 16])
def test_packed_null_block(spark, width):
    """Flags with null blocks only, null ones beside others, and none."""
    rows = [(1, None, 3), (2, 5, 1), (2, 90, 4), (2, None, 2), (3, 7, 1)]
    i = spark.createDataFrame(rows, index.SCHEMA)
    assert sorted(map(tuple, index.unpack(index.pack(i, width)).collect()), key=order) == sorted(rows, key=order)
