"""Runs a registered query beside its SQL and compares rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

DATA = Path("/root/testdata")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{sf}/{t}.parquet'")
    return con


def differences(spark, con, sf: str, query, sql: str) -> str:
    """Empty if both give the same columns and the same rows in any order."""
    got = query(spark, f"{DATA}/{sf}")
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    if sorted(cols) != sorted(got.columns):
        return f"columns {sorted(got.columns)} and {sorted(cols)}"
    order = sorted(cols)
    want = sorted((tuple(plain(dict(zip(cols, r, strict=True))[c]) for c in order) for r in res.fetchall()), key=repr)
    have = sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=repr)
    if len(want) != len(have):
        return f"rows {len(have)} and {len(want)}"
    bad = [(a, b) for a, b in zip(have, want, strict=True) if a != b]
    return f"{len(bad)} of {len(have)} rows differ, first {bad[0]}" if bad else ""
