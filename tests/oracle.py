"""Comparing a query with its SQL twin."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return f"{v:.9g}"
    if hasattr(v, "tzinfo") and v.tzinfo is not None:
        return v.replace(tzinfo=None)
    return v


def rows_of(columns: list[str], rows: list) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    flat = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(flat, key=lambda r: tuple((v is not None, str(v)) for v in r))


def difference(spark_df, con, sql: str) -> str | None:
    """None when both give the same columns, types of number and rows."""
    got_rows = spark_df.collect()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want_rows = cur.fetchall()
    if sorted(spark_df.columns) != sorted(names):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    got, want = rows_of(spark_df.columns, got_rows), rows_of(names, want_rows)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; only here {list(set(got) - set(want))[:2]}; only there {list(set(want) - set(got))[:2]}"
    for g, w in zip(got, want):
        if g != w or [type(x) for x in g] != [type(x) for x in w]:
            return f"first difference {g} != {w}"
    return None
