"""Queries with their SQL, by the name of their function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    """Registers a query; without SQL only tests check it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def sql_list(items) -> str:
    """A list of texts as a SQL literal."""
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"
