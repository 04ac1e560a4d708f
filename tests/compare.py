"""Spark results against DuckDB results of the same tables, as multisets of rows."""

from __future__ import annotations

import math
import os
from collections import Counter

DATA = "/root/testdata"


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in sorted(os.listdir(folder)):
        if name.endswith(".parquet"):
            con.execute(f"create view {name[:-8]} as select * from read_parquet('{folder}/{name}')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, bool) or value is None or isinstance(value, (int, str)):
        return value
    return float(value) if type(value).__name__ == "Decimal" else value


def rows_of(columns, rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], Counter(tuple(plain(r[k]) for k in order) for r in rows)


def compare(spark, con, make, sql: str, folder: str) -> str:
    """Empty if both agree, otherwise what differs."""
    df = make(spark, folder)
    names, ours = rows_of(df.columns, df.collect())
    result = con.execute(sql)
    other_names, theirs = rows_of([d[0] for d in result.description], result.fetchall())
    if names != other_names:
        return f"columns {names} and {other_names}"
    if ours != theirs:
        only, missing = ours - theirs, theirs - ours
        return f"{sum(ours.values())} rows and {sum(theirs.values())}; only here {list(only)[:3]}; only there {list(missing)[:3]}"
    return ""
