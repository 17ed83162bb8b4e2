"""Runs a query and its SQL side by side."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

import duckdb


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    if isinstance(x, Decimal):
        return f"{float(x):.9g}"
    return repr(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in data), [columns[i] for i in order]


def compare(spark, name, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = connection(sf_dir).sql(sql)
    want = rows(list(rel.columns), rel.fetchall())
    assert got[1] == want[1], name
    assert got[0] == want[0], name
    return len(want[0])
