"""Compare registered queries with their SQL statements on one data folder."""

from __future__ import annotations

import datetime
import math
import time

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return repr(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, fn, statement: str | None, sf_dir: str) -> tuple[bool, str]:
    """(matches, message); a query without a statement only has to run."""
    start = time.time()
    df = fn(spark, sf_dir)
    got_columns, got = _rows(df.columns, df.collect())
    took = time.time() - start
    if statement is None:
        return True, f"{len(got)} rows, {took:.1f}s, no statement"
    start = time.time()
    cursor = con.execute(statement)
    columns, want = _rows([c[0] for c in cursor.description], cursor.fetchall())
    sql_took = time.time() - start
    note = f"{len(got)} rows, {took:.1f}s, sql {sql_took:.1f}s"
    if got_columns != columns:
        return False, f"columns {got_columns} != {columns}"
    if got != want:
        a, b = set(got), set(want)
        return False, f"{note}; want {len(want)} rows; extra {list(a - b)[:2]}; missing {list(b - a)[:2]}"
    return True, note
