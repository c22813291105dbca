"""Compare a query with its SQL on the driver's tables."""

from __future__ import annotations

import glob
import os

import duckdb


def connection(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(value):
    if isinstance(value, float):
        return float(value)
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def rows_of(columns: list[str], rows) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


def same(spark, con, sf_dir: str, query, sql: str) -> str:
    """Empty if both give the same rows, else what differs."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    want = rows_of(columns, found.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    if got != want:
        more = next(((g, w) for g, w in zip(got, want, strict=False) if g != w), None)
        return f"{len(got)} and {len(want)} rows; first difference {more}"
    return ""
