"""Every registered query against its DuckDB oracle (sf0.001; the driver
repeats this at sf0.01)."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from oracle_compare import compare
from tripmart.plans.catalog import ORACLES, QUERIES

KEYS = sorted(QUERIES)


def test_every_key_has_an_oracle():
    assert set(E.oracle_sql()) <= set(E.queries()) and set(KEYS) <= set(E.queries())
    assert set(KEYS) == set(ORACLES)  # every key of the library has its SQL


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, duck_small, key):
    r = compare(spark, duck_small, key, E.queries()[key], E.oracle_sql().get(key), SF_SMALL)
    assert r["ok"], r


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["month", "user_types", "number_of_users"]
    assert len(rows) == 37
