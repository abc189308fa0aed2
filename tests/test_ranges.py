"""Counts of range joins, against the pairs themselves."""

from __future__ import annotations

import math

import pytest

from millrace import Port
from millrace import queries as engine
from millrace.plans.dialect import range_count

SCHEMA = [{"table": "spans", "columns": [{"name": "id", "type": "int"}, {"name": "kind", "type": "str"}, {"name": "lo", "type": "float"}], "primary": "id"}, {"table": "points", "columns": [{"name": "p", "type": "int"}, {"name": "x", "type": "float"}], "primary": "p"}]
SPANS = [(i, [None, "a", "b"][i % 3], [None, math.nan, math.inf, -0.0][i] if i < 4 else float(i * 7 % 50) - 10) for i in range(90)]
POINTS = [(i, [None, math.nan, -math.inf, 0.0][i] if i < 4 else float(i * i % 41) / 2) for i in range(120)]


@pytest.fixture
def port(spark, tmp_path):
    with Port.open(tmp_path, schema=SCHEMA, spark=spark) as p:
        p.insert_df("spans", spark.createDataFrame(SPANS, "id long, kind string, lo double"))
        p.insert_df("points", spark.createDataFrame(POINTS, "p long, x double"))
        yield p


def test_the_registered_join_makes_no_pairs(spark):
    plan = engine.QUERIES["join_range"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("keys, hi", [("kind, id", "lo + 5"), ("lo", "10"), ("kind", "lo - 1"), ("abs(lo)", "id"), ("id", "CASE WHEN id > 50 THEN lo + 1000 END")])
def test_counts_are_those_of_the_pairs(port, keys, hi):
    if "CASE" in hi:  # left to Spark
        assert range_count(f"SELECT {keys}, count(*) AS n FROM spans JOIN points ON x BETWEEN lo AND {hi} GROUP BY {keys}") is None
    ask = lambda sql: sorted(map(repr, map(tuple, port.query_df(sql).collect())))
    pairs = ask(f"SELECT {keys}, count(*) AS n FROM spans CROSS JOIN points WHERE x BETWEEN lo AND {hi} GROUP BY {keys}")
    assert ask(f"SELECT {keys}, count(*) AS n FROM spans JOIN points ON x BETWEEN lo AND {hi} GROUP BY {keys}") == pairs
    assert ask(f"SELECT {keys}, COUNT(*) AS n FROM points p INNER JOIN spans AS s ON p.x BETWEEN s.lo AND {hi} GROUP BY {keys}") == pairs


def test_other_range_joins_are_left_alone(port):
    for sql in ("SELECT id, sum(x) AS n FROM spans JOIN points ON x BETWEEN lo AND 3 GROUP BY id", "SELECT id, count(*) FROM spans LEFT JOIN points ON x BETWEEN lo AND 3 GROUP BY id", "SELECT id, count(*) FROM spans JOIN points ON x BETWEEN lo AND 3 AND p = id GROUP BY id",
                "SELECT id, count(*) FROM spans JOIN points ON x BETWEEN lo AND 3 GROUP BY id HAVING count(*) > 2", "SELECT id, count(*) FROM spans JOIN points ON x BETWEEN lo AND 3 WHERE p > 2 GROUP BY id", "SELECT id, count(*) FROM spans JOIN points ON x NOT BETWEEN lo AND 3 GROUP BY id", "SELECT 1, count(*) FROM spans JOIN points ON x BETWEEN lo AND 3 GROUP BY 1"):
        assert range_count(sql) is None
        port.query(sql)
    assert port.query("SELECT count(*) AS n, kind FROM spans JOIN points ON x BETWEEN lo AND lo + 5 GROUP BY kind")[0].keys() == {"n", "kind"}
