"""Compare a query with its SQL in DuckDB: the same columns, and the same rows in any order."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from pathlib import Path

import duckdb


def connection(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(directory).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def differences(df, sql: str, directory: str, kinds: bool = True) -> str:
    """Empty if both agree."""
    con = connection(directory)
    relation = con.execute(sql)
    names = [c[0] for c in relation.description]
    theirs = [dict(zip(names, r, strict=True)) for r in relation.fetchall()]
    ours = [r.asDict(recursive=True) for r in df.collect()]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    order = sorted(names)
    a = Counter(tuple(plain(r[n]) for n in order) for r in ours)
    b = Counter(tuple(plain(r[n]) for n in order) for r in theirs)
    if a == b:
        return ""
    return f"{len(ours)} rows against {len(theirs)}; only ours {list((a - b).items())[:3]}; only theirs {list((b - a).items())[:3]}; columns {order}"
