"""Comparing Spark's rows with DuckDB's, whatever the order of rows and columns."""

from __future__ import annotations

import decimal
import math
from pathlib import Path


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    """Numbers of any type to 9 digits, nested values as tuples, the rest as text."""
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        x = float(v)
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return str(v)


def spark_rows(df) -> list[tuple]:
    names = sorted(df.columns)
    return sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)


def assert_same(df, con, sql: str) -> int:
    """The rows of df are those of sql; returns their number."""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in sorted(names)]
    want = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
    got = spark_rows(df)
    assert len(got) == len(want)
    assert got == want
    return len(got)
