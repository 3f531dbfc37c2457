"""The operators' queries against DuckDB, where SQL can express them."""

import os

import duckdb
import pytest

from lumenrank.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    db = duckdb.connect()
    for t in os.listdir(SF):
        db.execute(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    df = queries.queries()[name](spark, SF)
    found = db.execute(queries.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(str(tuple(r[c] for c in names)) for r in df.collect()) == sorted(map(str, found.fetchall()))
