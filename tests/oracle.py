"""Compares queries with their SQL in DuckDB."""

import glob
import math
import os

import duckdb


def connected(sf):
    db = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        db.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return db


def plain(v):
    if hasattr(v, "isoformat"):
        return str(v)[:19]
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    key = lambda r: [(x is None, str(type(x)), x if x is not None else 0) for x in r]
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=key)


def differences(spark, sf, query, sql):
    got = query(spark, sf)
    a = rows_of(got.columns, [tuple(r) for r in got.collect()])
    r = connected(sf).execute(sql)
    b = rows_of([c[0] for c in r.description], r.fetchall())
    if a[0] != b[0]:
        return f"columns {a[0]} {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"{len(a[1])} rows, {len(b[1])} expected"
    bad = [(x, y) for x, y in zip(a[1], b[1], strict=True) if x != y]
    return f"{len(bad)} rows differ, such as {bad[:3]}" if bad else ""
