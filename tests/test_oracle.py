"""Every registered query with SQL equals its DuckDB oracle on the small tables."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from oracle_check import compare, duck

ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, con, name):
    ok, msg = compare(spark, con, name, E.queries()[name], ORACLE[name], SF_SMALL)
    assert ok, msg


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "avg_arr_delay" in df.columns


def test_every_query_has_a_callable_and_no_orphan_sql():
    assert set(ORACLE) <= set(E.queries())
