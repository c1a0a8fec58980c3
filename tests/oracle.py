"""Holds a query's rows against those of its SQL on DuckDB, as sets with counts; columns are matched by name."""

from __future__ import annotations

import math
from collections import Counter
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb


def _plain(x):
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, (int, float, Decimal)):
        return "nan" if math.isnan(x) else round(float(x), 5) + 0.0
    if isinstance(x, (date, datetime)):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(_plain(v) for v in x)
    return repr(x)


def connected(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if both sides agree, else what differs."""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    theirs = Counter(tuple(_plain(r[names.index(c)]) for c in order) for r in found.fetchall())
    ours = Counter(tuple(_plain(r[c]) for c in order) for r in df.collect())
    if not theirs:
        return "the SQL has no rows"
    if ours == theirs:
        return ""
    more, less = list((ours - theirs).items()), list((theirs - ours).items())
    return f"{sum(ours.values())} and {sum(theirs.values())} rows; {order}\n  only here ({len(more)}): {sorted(more, key=repr)[:3]}\n  only in SQL ({len(less)}): {sorted(less, key=repr)[:3]}"
