"""Runs a query and its SQL, and tells how they differ."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if v is None or v is pd.NA or v != v:
        return None
    if isinstance(v, float) and v.is_integer():  # pandas has no integer column with gaps
        return int(v)
    if hasattr(v, "isoformat"):
        return str(v)[:19].replace(" 00:00:00", "")
    return v


def difference(spark, con, folder: str, query, sql: str) -> str:
    """Empty if both give the same rows under the same names."""
    got = query(spark, folder).toPandas()
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    names = sorted(got.columns)
    a, b = (sorted((tuple(map(plain, r)) for r in df[names].itertuples(index=False, name=None)), key=repr) for df in (got, want))
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows: {bad[:3]}" if bad else ""
