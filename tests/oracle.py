"""Compares a query's rows with its oracle's rows in DuckDB."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x + 0.0)
    if isinstance(x, (list, tuple)):
        return tuple(_plain(v) for v in x)
    if isinstance(x, dict):
        return tuple(sorted((k, _plain(v)) for k, v in x.items()))
    return str(x) if x is not None and not isinstance(x, (int, bool, str)) else x


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def differences(df, sql: str, sf_dir: str) -> str:
    """Empty if rows, column names and values agree."""
    con = views(sf_dir)
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    want_rows = found.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    want = Counter(tuple(_plain(r[names.index(c)]) for c in order) for r in want_rows)
    got = Counter(tuple(_plain(r[c]) for c in order) for r in df.collect())
    if got == want:
        return ""
    return f"{sum(got.values())} and {sum(want.values())} rows; only Spark {list((got - want).items())[:3]}; only SQL {list((want - got).items())[:3]}"
