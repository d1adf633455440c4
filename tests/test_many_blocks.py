"""Queries with a row per flag, over flags with more blocks than a range of ``index.PACKED`` holds."""

from __future__ import annotations

import duckdb
import pytest

from bitquarry import checks, queries
from bitquarry.operators import index

QUERIES, ORACLE = queries.QUERIES | checks.QUERIES, queries.ORACLE | checks.ORACLE
BLOCKS = 200_000


@pytest.mark.parametrize("name", ["bins", "pack", "varint_roundtrip", "bins_arrays", "pack_arrays"])
def test_many_blocks(spark, tmp_path, name):
    """Flags with blocks of several ranges against the SQL."""
    assert BLOCKS > 2 * index.PACKED
    items = spark.range(BLOCKS).selectExpr(
        "id * 64 as l_orderkey", "id % 7 as l_partkey", "16 as l_suppkey", "cast(1 + id % 3 as int) as l_linenumber", "10.0D as l_quantity", "0.0D as l_discount", "0.0D as l_tax", "'N' as l_returnflag", "'O' as l_linestatus"
    )
    items.union(items.filter("l_orderkey % 5 = 0")).write.parquet(f"{tmp_path}/lineitem.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    df = QUERIES[name](spark, str(tmp_path))
    columns = sorted(df.columns)
    want = c.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE[name]})").fetchall()
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(want)
