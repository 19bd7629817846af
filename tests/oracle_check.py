"""Compare a driver query with its oracle SQL on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb

SMALL = "/root/testdata/sf0.001"


def _text(v) -> str:
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


def same_as_oracle(spark, query, sql: str) -> None:
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = query(spark, SMALL)
    columns = sorted(df.columns)
    got = sorted(tuple(_text(r[c]) for c in columns) for r in df.collect())
    result = con.execute(sql)
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    want = sorted(tuple(_text(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert got == want


def no_product(df) -> None:
    """No cross join in the plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
