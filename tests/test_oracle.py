"""Each registered query of the engine against its SQL."""

from __future__ import annotations

import oracle
import pytest

import __spark_entry__ as entry
from millrace import queries as engine

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(engine.QUERIES))
def test_query(spark, name):
    oracle.check(engine.QUERIES[name], engine.ORACLE_SQL[name], spark, SF)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["o_orderstatus", "n", "total"] and df.count() > 0


def test_window_and_filter_reach_the_scan(spark):
    plan = engine.run(spark, SF, "SELECT o_orderstatus, count(*) AS c FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus", "orders")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,1000.0)]" in plan
    assert "o_orderpriority" not in plan.split("ReadSchema")[1]
