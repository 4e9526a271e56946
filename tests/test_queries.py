"""Every registered query against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tessera.queries import oracle_sql, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df):
    def plain(x):
        if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and x != x:
            return "null"
        if isinstance(x, bool) or type(x).__name__ == "bool":
            return str(bool(x))
        return repr(float(x)) if not isinstance(x, str) and hasattr(x, "__float__") else str(x)

    columns = sorted(df.columns)
    return columns, sorted(tuple(map(plain, r)) for r in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", list(queries()))
def test_against_duckdb(spark, duck, name):
    assert rows(queries()[name](spark, SF).toPandas()) == rows(duck.execute(oracle_sql()[name]).df())
