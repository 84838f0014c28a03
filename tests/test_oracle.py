"""Every registered query against its DuckDB oracle on the smallest tables."""

import pytest

from tests.conftest import SF_SMOKE

pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con():
    from tools.oracle_check import duck
    return duck(SF_SMOKE)


def _names():
    from dealscope.plans.catalog import oracle_sql
    return sorted(oracle_sql())


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, con, name):
    from dealscope.plans.catalog import oracle_sql, queries
    from tools.oracle_check import check
    assert check(spark, con, SF_SMOKE, name, queries()[name], oracle_sql()[name])


def test_every_query_has_oracle():
    from dealscope.plans.catalog import oracle_sql, queries
    assert set(queries()) == set(oracle_sql())


def test_entry_smoke(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert df.count() >= 0 and "sector" in df.columns
