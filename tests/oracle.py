"""Run a registered query and its SQL counterpart and compare rows, columns and values."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        return f"{float(value):.9g}"
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value:.9g}"
    if isinstance(value, int):
        return f"{float(value):.9g}" if abs(value) < 10**15 else str(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder, fn, sql):
    """None when equal, else a short description of the difference."""
    df = fn(spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        if operator in plan:
            return f"plan has a {operator}"
    left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if left else "no rows"
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    right = rows_of(columns, cur.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if len(left) != len(right):
        only_l = [x for x in left if x not in set(right)][:2]
        only_r = [x for x in right if x not in set(left)][:2]
        return f"rows {len(left)} != {len(right)} spark={only_l} sql={only_r}"
    different = [(a, b) for a, b in zip(left, right) if a != b]
    return f"{len(different)} rows differ, e.g. spark={different[0][0]} sql={different[0][1]}" if different else None
