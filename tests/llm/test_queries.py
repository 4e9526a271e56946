"""The registered queries that SQL can express, against DuckDB on the smallest tables."""

import duckdb
import pytest

from tessera.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    wanted, got = con.execute(oracle_sql()[name]).df(), queries()[name](spark, SF).toPandas()
    columns = sorted(wanted.columns)
    assert columns == sorted(got.columns)
    rows = lambda df: sorted(tuple(repr(float(x)) if hasattr(x, "__float__") and not isinstance(x, str) else str(x) for x in r) for r in df[columns].itertuples(index=False))
    assert rows(got) == rows(wanted)


def test_all_are_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in queries()) == list(range(1, 11))
