"""Queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def connection():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for name in os.listdir(SF):
        p = f"{SF}/{name}"
        c.sql(f"create view {name[: -len('.parquet')]} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def _plain(x):
    if isinstance(x, (list, tuple)) or type(x).__name__ == "ndarray":
        return [_plain(y) for y in x]
    if x is None or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool) or type(x).__name__ == "bool_":
        return bool(x)
    return float(x) if hasattr(x, "__float__") and not isinstance(x, str) else str(x)


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)]
    return sorted(repr([_plain(v) for v in r]) for r in df.itertuples(index=False))


def same(spark, c, query, sql) -> None:
    a, b = query(spark, SF).toPandas(), c.sql(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)
