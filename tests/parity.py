"""Holds a query against its SQL in DuckDB."""

from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal
from pathlib import Path


def connection(sf_dir: str):
    import duckdb

    c = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.12g}")
    return v


def compare(spark, sf_dir: str, query, sql: str) -> str:
    """Empty if both give the same rows and column names, else what differs."""
    df = query(spark, sf_dir)
    cur = connection(sf_dir).execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(set(names) ^ set(df.columns))}"
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    want = Counter(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if got != want:
        return f"{got.total()} rows against {want.total()}; only here {list((got - want).items())[:2]}; only in SQL {list((want - got).items())[:2]}; {cols}"
    types = {d[0]: str(d[1]) for d in cur.description}
    loose = [(c, t, types[c]) for c, t in df.dtypes if "HUGEINT" in types[c] or "DECIMAL" in types[c] or ("INTEGER" in types[c]) != (t == "int")]
    return f"types {loose}" if loose else ""
