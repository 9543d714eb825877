"""Run a registered query on Spark and its SQL on DuckDB, and compare whole results."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir) / f"{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (int, str)):
        return v
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([_norm(r[i]) for i in order] for r in rows), key=repr), [columns[i] for i in order]


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) <= 2e-5 + 1e-9 * abs(a)
    return a == b and type(a) is type(b)


def differences(spark, query, sql, sf_dir, con=None):
    """Empty string when equal, else a short description."""
    df = query(spark, sf_dir)
    got, cols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = (con or duck(sf_dir)).execute(sql)
    want, wcols = rows_of([d[0] for d in cur.description], cur.fetchall())
    if cols != wcols:
        return f"columns {cols} != {wcols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; e.g. {got[:2]} / {want[:2]}"
    for g, w in zip(got, want, strict=True):
        if not all(close(a, b) for a, b in zip(g, w, strict=True)):
            return f"{dict(zip(cols, g))} != {dict(zip(cols, w))}"
    return "" if got else "EMPTY"
