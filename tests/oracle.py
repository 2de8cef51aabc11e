"""Run a registered query and its SQL twin and compare them row by row."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    return con


def _key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(r[i] for i in order) for r in rows]
    return sorted(columns), sorted(out, key=lambda r: tuple((v is None, repr(v)) for v in r))


def compare(spark, con, query, sql, root: str) -> str | None:
    """None when equal, else a description of the first difference."""
    started = time.time()
    df = query(spark, root)
    got_cols, got = _sorted(df.columns, [tuple(r) for r in df.collect()])
    spark_s = time.time() - started
    started = time.time()
    cur = con.execute(sql)
    want_cols, want = _sorted([d[0] for d in cur.description], cur.fetchall())
    compare.timing = (spark_s, time.time() - started, len(got))
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for g, w in zip(got, want):
        for c, a, b in zip(got_cols, g, w):
            if type(a) is not type(b) or a != b:
                if isinstance(a, float) and isinstance(b, float) and (
                    math.isnan(a) and math.isnan(b)
                ):
                    continue
                return f"{c}: {a!r} != {b!r} in {g} vs {w}"
    return None
