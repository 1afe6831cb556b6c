"""The table of runnable queries and their SQL statements for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a callable (spark, folder) -> DataFrame, with its SQL if it has one."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query exists already: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
