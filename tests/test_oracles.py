"""Every segmentation query against its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from tessella import queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted(tuple(r) for r in df.select(*columns).collect())
    theirs = duck.sql(queries.oracle_sql()[name])
    assert sorted(theirs.columns) == columns
    assert ours == sorted(duck.sql(f"SELECT {', '.join(columns)} FROM theirs").fetchall())


