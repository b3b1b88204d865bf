"""Run registered queries on Spark and their SQL on DuckDB and compare the rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return 0.0 if v == 0 else v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(df, con, sql: str) -> str | None:
    """None when equal, else a short description of the first difference."""
    left_names, left = _rows(df.columns, df.collect())
    cur = con.execute(sql)
    right_names, right = _rows([d[0] for d in cur.description], cur.fetchall())
    if left_names != right_names:
        return f"columns {left_names} <> {right_names}"
    if len(left) != len(right):
        only = list(set(left) - set(right))[:2], list(set(right) - set(left))[:2]
        return f"{len(left)} rows <> {len(right)} rows {only}"
    if left != right:
        diff = [(a, b) for a, b in zip(left, right) if a != b]
        return f"{len(diff)} rows differ, e.g. {diff[0]}"
    return None
