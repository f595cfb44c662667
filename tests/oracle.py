"""Compare a query with its SQL, as rows without order."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    if hasattr(v, "tolist"):
        return plain(v.tolist())
    return v


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def differences(df, sql: str, con) -> str:
    """Empty when the two agree."""
    rel = con.sql(sql)
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {df.columns} and {rel.columns}"
    got, want = rows_of(df.columns, df.collect()), rows_of(rel.columns, rel.fetchall())
    if got == want:
        return ""
    return f"{sum(got.values())} rows, {sum(want.values())} wanted; only in Spark {list((got - want).items())[:3]}; only in SQL {list((want - got).items())[:3]}"
