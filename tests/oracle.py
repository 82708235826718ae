"""Holds a query's rows against its SQL, run by DuckDB over the same tables."""

from __future__ import annotations

import math
import os

import duckdb
from pyspark.sql import DataFrame

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return v


def _rows(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def differences(con: duckdb.DuckDBPyConnection, sql: str, df: DataFrame) -> str:
    """Empty if columns and rows are the same, up to the last bits of doubles."""
    got = df.collect()
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    want, have = _rows(names, rel.fetchall()), _rows(df.columns, [tuple(r) for r in got])
    if len(want) != len(have):
        return f"{len(have)} rows, {len(want)} expected"
    bad = [(a, b) for a, b in zip(have, want, strict=True) if a != b and not all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 1e-9 * max(1, abs(y))) for x, y in zip(a, b, strict=True))]
    return f"{len(bad)} of {len(want)} rows differ, e.g. {bad[0]}" if bad else ""
