"""Compares a query with its SQL on DuckDB: rows, columns and values, order aside."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return v.isoformat() if hasattr(v, "isoformat") else v


def same(df, con, sql: str) -> tuple[bool, str]:
    rel = con.sql(sql)
    names = sorted(rel.columns)
    if sorted(df.columns) != names:
        return False, f"columns {sorted(df.columns)} {names}"
    want = sorted([tuple(str(plain(r[rel.columns.index(c)])) for c in names) for r in rel.fetchall()])
    got = sorted([tuple(str(plain(r[c])) for c in names) for r in df.collect()])
    if want != got:
        diff = next(((a, b) for a, b in zip(got, want, strict=False) if a != b), None)
        return False, f"{len(got)} rows, {len(want)} wanted, first difference {diff}"
    return True, ""
