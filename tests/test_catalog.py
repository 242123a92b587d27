"""Every catalogue entry gives the rows that DuckDB gives for its oracle."""

import os

import duckdb
import pytest

from resultfeed import catalog

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in catalog.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_rows(spark, duck, name):
    df, rel = catalog.queries()[name](spark, DIR), duck.sql(catalog.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    plain = lambda x: round(x, 6) if isinstance(x, float) else x
    at = [rel.columns.index(c) for c in columns]
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)
    assert mine == theirs
