"""The SQL of the operators gives their rows on whole small tables."""

import os

import duckdb
import pytest

from resultfeed.llm import catalog

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
@pytest.mark.parametrize("name", [n for n in catalog.oracle_sql() if n != "op2_mixing"])  # op2 has a test of its own, for floats
def test_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    rel = con.sql(catalog.oracle_sql()[name])
    columns = sorted(rel.columns)
    mine = catalog.queries()[name](spark, DIR).select(*columns)
    assert sorted(map(tuple, mine.collect()), key=str) == sorted(rel.select(*columns).fetchall(), key=str)
