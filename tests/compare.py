"""Results of a registered query and of its SQL, in a form to compare."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    """A connection with one view per table of the folder."""
    connection = duckdb.connect()
    for name in TABLES:
        path = os.path.join(folder, f"{name}.parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


SQL_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def _plain(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def _sorted_rows(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=lambda row: tuple((v is None, v) for v in row))


def difference(df, connection: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs between a DataFrame and a statement's result, or None."""
    expected = connection.execute(sql)
    names = [c[0] for c in expected.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    kinds = {c[0]: str(c[1]) for c in expected.description}
    for name, kind in df.dtypes:
        if SQL_TYPES[kind] != kinds[name]:
            return f"{name} is {kind} against {kinds[name]}"
    theirs = _sorted_rows(names, expected.fetchall())
    ours = _sorted_rows(df.columns, [tuple(row) for row in df.collect()])
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    for mine, other in zip(ours, theirs):
        if mine != other:
            return f"{mine} against {other}"
    return None
