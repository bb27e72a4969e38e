"""Run a query and its SQL on the same tables and compare the rows."""

from __future__ import annotations

import datetime
import decimal
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    rows = df.select(*names).collect()
    return names, Counter(tuple(plain(v) for v in r) for r in rows)


def sql_rows(con, sql: str) -> tuple[list[str], Counter]:
    cur = con.execute(sql)
    got = [d[0] for d in cur.description]
    order = sorted(range(len(got)), key=lambda i: got[i])
    rows = Counter(tuple(plain(r[i]) for i in order) for r in cur.fetchall())
    return [got[i] for i in order], rows


def compare(df, con, sql: str) -> str | None:
    """None where both agree, else what differs."""
    names, ours = spark_rows(df)
    other_names, theirs = sql_rows(con, sql)
    if names != other_names:
        return f"columns {names} against {other_names}"
    if ours == theirs:
        return None
    more, less = ours - theirs, theirs - ours
    return (
        f"{sum(ours.values())} rows against {sum(theirs.values())}; "
        f"only ours {list(more.items())[:3]}; only theirs {list(less.items())[:3]}"
    )
