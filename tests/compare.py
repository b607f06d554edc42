"""Spark rows against DuckDB rows, as text: column names, row count, values in any order."""

import datetime
import decimal
import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def text(x):
    if x is None:
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        if math.isnan(x):
            return "nan"
        return f"{x + 0.0:.6g}" if x else "0"
    if isinstance(x, int):
        return f"{x:.6g}" if abs(x) < 1e6 else str(x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(text, x)) + "]"
    if isinstance(x, dict):
        return "{" + ",".join(f"{k}:{text(v)}" for k, v in sorted(x.items())) + "}"
    return str(x)


def oracle_rows(sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return names, found.fetchall()


def differences(df, sql, sf_dir):
    """None if all is equal, else what differs."""
    names, rows = oracle_rows(sql, sf_dir)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    order = sorted(names)
    got = Counter(tuple(text(r[c]) for c in order) for r in (x.asDict(True) for x in df.collect()))
    want = Counter(tuple(text(r[names.index(c)]) for c in order) for r in rows)
    if got != want:
        return f"{sum(got.values())} against {sum(want.values())} rows; only in Spark {list((got - want).items())[:3]}, only in SQL {list((want - got).items())[:3]}"
    return None
