"""Queries against DuckDB on the smallest tables, where these are."""

import math
import os

import duckdb
import pytest

from lumenrank import queries as own

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
#: One of each kind; the driver runs all.
NAMES = ["postings_topterms", "match_phrase", "geo_distance", "nested_bool", "filter_mode", "validate_feature", "model_ranklib_ranknet", "model_ranklib_rankboost", "rescore_index_log", "blended_one_field", "field_stats", "explorer_stddev_classic_idf", "explorer_avg_raw_tp", "term_stat_tp_posaggr_min", "match_phrase_slop", "bool_filter", "derived_functions", "model_xgb_dump", "model_large_ensemble", "feature_log_long", "rescore_chain", "training_set_join", "ndcg_at_10", "script_feature", "template_render", "flagship"]


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, db, name):
    df = own.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    found = db.execute(own.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    assert got == sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in found.fetchall())


def test_entry_imports():
    import __spark_entry__ as e

    assert set(own.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
