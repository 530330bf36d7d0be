"""Name -> query function and oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from regioflux.workload.fixture_sql import with_fixtures

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, fixtures: tuple[str, ...] = (), recursive: bool = False) -> Callable[[Query], Query]:
    """Registers a query under its function name, with the SQL that must give the same rows."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            given = with_fixtures(*fixtures) if fixtures else ""
            ORACLES[function.__name__] = (given.replace("WITH ", "WITH RECURSIVE ", 1) if recursive else given) + sql.strip()
        return function

    return register
