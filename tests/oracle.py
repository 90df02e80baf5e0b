"""Compare a query with its SQL in DuckDB, rows as multisets."""

from __future__ import annotations

import math
import os
from collections import Counter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TIDEMARK_TEST_DATA", "/root/testdata/sf0.001")


def _cell(v):
    import pandas as pd

    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return float(f"{v:.10g}")
    return v


def rows(df) -> Counter:
    df = df[sorted(df.columns)]
    return Counter(tuple(map(_cell, r)) for r in df.itertuples(index=False))


def check(spark, query, sql: str, data: str = DATA) -> None:
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{data}/{t}.parquet"):
            con.execute(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    got, want = query(spark, data).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])
