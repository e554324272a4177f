"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import differences
from conftest import SMALL

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    result = QUERIES[name](spark, SMALL)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name in ORACLES:
        assert differences(result, duck, ORACLES[name]) == []
    else:
        assert result.count() >= 0


def test_entry_has_rows_and_a_stable_schema(spark):
    result = entry.entry(spark)
    assert result.count() > 0
    assert result.columns == ["id", "capture_sort_key"]


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
