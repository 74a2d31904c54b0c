"""Comparison of a registered query with its SQL in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def plain(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    return value


def same(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    """Equal columns, and equal rows whatever their order."""
    columns = sorted(df.columns)
    found = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    asked = con.execute(sql)
    names = [d[0] for d in asked.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    wanted = [tuple(plain(r[i]) for i in order) for r in asked.fetchall()]
    key = lambda row: tuple(map(str, row))
    assert sorted(found, key=key) == sorted(wanted, key=key)
