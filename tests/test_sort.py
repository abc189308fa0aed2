from __future__ import annotations

from millrace import queries as engine

SF = "/root/testdata/sf0.1"


def test_all_rows_are_sorted_nulls_last(spark):
    """Of a table with more rows than the SQL's limit none is cut, and the null keys are at the end."""
    got = [tuple(r) for r in engine.QUERIES["sort_nulls_last"](spark, SF).collect()]
    rows = [(None if r.c_nationkey == 3 else r.c_nationkey, r.c_custkey) for r in spark.read.parquet(f"{SF}/customer.parquet").select("c_nationkey", "c_custkey").collect()]
    assert len(rows) > 2000 and got == sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert got[-1][0] is None
