"""Plan guards for every registered query: the shapes that break at scale."""

import re

import pytest

from tests.conftest import SF_SMOKE


def _names():
    from dealscope.plans.catalog import queries
    return sorted(queries())


@pytest.fixture(scope="module")
def plans(spark):
    from dealscope.plans.catalog import queries
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = {}
        for name, fn in queries().items():
            out[name] = fn(spark, SF_SMOKE)._jdf.queryExecution().executedPlan().toString()
        return out
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("name", _names())
def test_plan_shape(plans, name):
    plan = plans[name]
    # No all-pairs joins.
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # No Python evaluation in the hot path.
    assert not re.search(r"BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas|MapInPandas", plan)
    # No window that pulls every row into one partition.
    for line in plan.split("\n"):
        if re.search(r"\bWindow \[", line):
            assert not re.search(r"\], \[\], \[", line), line
    # Every keyed aggregation is pre-aggregated map-side before its shuffle.
    finals = len(re.findall(r"HashAggregate\(keys=\[[^\]]+\], functions=\[(?!partial_)", plan))
    partials = len(re.findall(r"functions=\[partial_", plan))
    assert partials >= finals or finals == 0
