"""The registered queries against their DuckDB SQL on the smallest tables."""

import pytest

from dealscope.llm.queries import oracle_sql, queries
from tests.conftest import SF_SMOKE
from tools.oracle_check import check, duck


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMOKE)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    assert check(spark, con, SF_SMOKE, name, queries()[name], oracle_sql()[name])


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 14))
