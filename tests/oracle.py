"""Runs a query and its DuckDB SQL over the same tables and compares their rows, as the driver does."""

from __future__ import annotations

import math
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if hasattr(v, "asDict"):
        return tuple(map(plain, v))
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((repr([plain(r[i]) for i in order]) for r in rows))


def differences(spark, query, sql, sf_dir) -> str:
    """Empty if both give the same rows."""
    con = duckdb.connect()
    for t in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{t}')")
    rel = con.execute(sql)
    names, want = rows_of([c[0] for c in rel.description], rel.fetchall())
    df = query(spark, sf_dir)
    got_names, got = rows_of(df.columns, df.collect())
    if names != got_names:
        return f"columns {got_names} instead of {names}"
    if len(got) != len(want):
        return f"{len(got)} rows instead of {len(want)}"
    wrong = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return f"{len(wrong)} rows differ, as {wrong[:3]}" if wrong else ""
