"""Comparison of a Spark result with DuckDB's, as sets of rows with equal columns."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    return str(x) if hasattr(x, "isoformat") else x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def compare(df, con, sql: str) -> str:
    """Empty if equal, else what differs first."""
    names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_names, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if names != want_names:
        return f"columns {names} and {want_names}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    return next((f"{a} and {b}" for a, b in zip(got, want, strict=True) if a != b), "")
