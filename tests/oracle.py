"""Compares a query with its oracle: column names, types, row count and exact values."""

from __future__ import annotations

import math

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

TYPES = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _sortable(row: tuple) -> tuple:
    return tuple((value is not None, str(type(value)), value if value is not None else 0) for value in row)


def differences(found: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    cursor = connection.execute(sql)
    wanted_types = {d[0]: str(d[1]) for d in cursor.description}
    wanted_rows = cursor.fetchall()
    order = sorted(wanted_types)
    found_types = {f.name: TYPES.get(f.dataType.simpleString(), "?") for f in found.schema}
    if found_types != wanted_types:
        return [f"types: {found_types} instead of {wanted_types}"]
    places = {name: i for i, name in enumerate(wanted_types)}
    wanted = sorted(
        (tuple(row[places[c]] for c in order) for row in wanted_rows), key=_sortable
    )
    rows = sorted((tuple(row[c] for c in order) for row in found.collect()), key=_sortable)
    if len(rows) != len(wanted):
        return [f"{len(rows)} rows instead of {len(wanted)}"]
    for got, want in zip(rows, wanted):
        for name, a, b in zip(order, got, want):
            same = a == b or (isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b))
            if not same:
                return [f"{name}: {a!r} instead of {b!r} in {got} / {want}"]
    return []
