"""Order-insensitive comparison of a query with its SQL."""

from __future__ import annotations

from collections import Counter
from datetime import date, datetime

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _value(v):
    if isinstance(v, datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, date):
        return v.isoformat()
    return v


def difference(df, con, sql: str) -> str | None:
    """Text that says how the results differ, or None."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    expected = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns: spark only {set(df.columns) - set(names)}, sql only {set(names) - set(df.columns)}"
    order = sorted(names)
    got = Counter(tuple(_value(r[n]) for n in order) for r in df.collect())
    want = Counter(tuple(_value(r[names.index(n)]) for n in order) for r in expected)
    if got != want:
        more, less = list((got - want).items())[:2], list((want - got).items())[:2]
        return f"rows {sum(got.values())} vs {sum(want.values())}; columns {order}\n spark {more}\n sql   {less}"
    return None
