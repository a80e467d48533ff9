"""Spark's rows against DuckDB's: the same names, the same rows as multisets."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def connection(sf_dir: str = SF) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def _plain(x):
    return round(x, 6) if isinstance(x, float) else tuple(map(_plain, x)) if isinstance(x, list | tuple) else x


def rows(columns: list[str], found) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in found)


def difference(df, sql: str, c: duckdb.DuckDBPyConnection) -> str:
    """Empty, or what differs."""
    got = c.sql(sql)
    if sorted(df.columns) != sorted(got.columns):
        return f"columns {df.columns} against {got.columns}"
    a, b = rows(df.columns, df.collect()), rows(got.columns, got.fetchall())
    return "" if a == b else f"{sum(a.values())} against {sum(b.values())} rows; only Spark {list((a - b).items())[:3]}; only SQL {list((b - a).items())[:3]}"
