"""Compare a query with its SQL, row by row."""

from __future__ import annotations

from pathlib import Path

import duckdb

DATA = Path("/root/testdata")


def _plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in values), key=repr)


def duck(sql: str, sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    return sorted(names), rows(names, r.fetchall())


def check(query, sql: str, spark, sf_dir: str) -> int:
    df = query(spark, sf_dir)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    names, theirs = duck(sql, sf_dir)
    assert sorted(df.columns) == names
    assert len(mine) == len(theirs), (len(mine), len(theirs))
    wrong = [(a, b) for a, b in zip(mine, theirs) if a != b]
    assert not wrong, (len(wrong), str(wrong[0])[:1500])
    return len(mine)
