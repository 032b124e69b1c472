"""Compare Spark results with their SQL twins in DuckDB, order-insensitively."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _norm(v):
    if isinstance(v, (float, Decimal)):
        v = float(v)
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, bool):
        return repr(v)
    if isinstance(v, dict):
        return repr({k: _norm(x) for k, x in v.items()})
    if isinstance(v, (list, tuple)):
        return repr([_norm(x) for x in v])
    return repr(v)


def _kind(v):
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return "int"
    return type(v).__name__


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in data)


def compare(spark, con, fn, sql, folder, inspect=None):
    """Returns (row count, problem or None). ``inspect`` gets to see the DataFrame first."""
    df = fn(spark, folder)
    if inspect is not None:
        inspect(df)
    got = [tuple(r) for r in df.collect()]
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = res.fetchall()
    if sorted(df.columns) != sorted(names):
        return len(got), f"columns {sorted(df.columns)} vs {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if len(a) != len(b):
        return len(got), f"rows {len(a)} vs {len(b)}; first only here {next((x for x in a if x not in set(b)), None)}; only there {next((x for x in b if x not in set(a)), None)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        sa, sb = set(a), set(b)
        return len(got), (
            f"{len(bad)} rows differ; order {sorted(df.columns)}; "
            f"here {[x for x in a if x not in sb][:2]} there {[x for x in b if x not in sa][:2]}"
        )
    return len(got), None
