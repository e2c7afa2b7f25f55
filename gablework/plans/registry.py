"""Registration of catalogue queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a query under its function's name; sql gives the same rows on the same tables, if SQL can state it."""

    def add(fn: QueryFn) -> QueryFn:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql.strip()
        return fn

    return add
