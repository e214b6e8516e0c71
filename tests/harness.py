"""Compare a registered query with its SQL, as sets of rows."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _plain(value):
    if value is None:
        return "\0null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or hasattr(value, "is_nan"):
        number = float(value)
        return "nan" if math.isnan(number) else f"{number:.9g}"
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(df, connection, sql: str) -> str | None:
    """None if equal, else what differs."""
    cursor = connection.execute(sql)
    expected_columns, expected = _rows([c[0] for c in cursor.description], cursor.fetchall())
    columns, rows = _rows(df.columns, [tuple(r) for r in df.collect()])
    if columns != expected_columns:
        return f"columns {columns} != {expected_columns}"
    if len(rows) != len(expected):
        return f"{len(rows)} rows != {len(expected)}"
    wrong = [(a, b) for a, b in zip(rows, expected) if a != b]
    return f"{len(wrong)} of {len(rows)} rows differ, first {wrong[0]}" if wrong else None
