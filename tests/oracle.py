"""Runs a query in Spark and its SQL in DuckDB and compares rows, whatever their order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    return value


def rows(names: list[str], data) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def difference(spark, sf_dir: str, build, sql: str) -> str:
    """Empty if both give the same."""
    df = build(spark, sf_dir)
    got = rows(df.columns, df.collect())
    result = views(sf_dir).execute(sql)
    names = [c[0] for c in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    want = rows(names, result.fetchall())
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    for a, b in zip(got, want, strict=True):
        if a != b:
            return f"{str(a)[:300]} and {str(b)[:300]}"
    return ""
