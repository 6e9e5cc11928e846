"""Compares a query with its SQL, as multisets of rows with columns by name."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _cell(value):
    if isinstance(value, float) and not math.isnan(value):
        return round(value, 9)
    return value


def _rows(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(df, connection, sql: str) -> list[str]:
    got_names = df.columns
    cursor = connection.execute(sql)
    want_names = [d[0] for d in cursor.description]
    if sorted(got_names) != sorted(want_names):
        return [f"columns {sorted(got_names)} != {sorted(want_names)}"]
    got = _rows(got_names, [tuple(r) for r in df.collect()])
    want = _rows(want_names, cursor.fetchall())
    extra, missing = got - want, want - got
    notes = [f"rows {sum(got.values())} / {sum(want.values())}"] if extra or missing else []
    for label, rows in (("only here", extra), ("only in SQL", missing)):
        notes += [f"{label}: {row}" for row in list(rows)[:3]]
    return notes
