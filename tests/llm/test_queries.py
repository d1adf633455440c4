"""Every registered query of the subpackage that has SQL, against DuckDB."""

from __future__ import annotations

import os

import duckdb
import pytest

from bitquarry.llm.queries import ORACLE, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in sorted(os.listdir(DIR)):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{t}'")
    df = QUERIES[name](spark, DIR)
    columns = ", ".join(sorted(df.columns))
    want = con.sql(f"SELECT {columns} FROM ({ORACLE[name]})").fetchall()
    got = list(map(tuple, df.select(*sorted(df.columns)).collect()))
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and got


def test_registration():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{n}" for n in range(1, 11)} and set(ORACLE) <= set(QUERIES)
