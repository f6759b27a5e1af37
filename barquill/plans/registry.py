"""Queries by name, and SQL with the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "ohlc_hourly"


def add(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def register(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql:
            ORACLE_SQL[query.__name__] = sql
        return query

    return register
