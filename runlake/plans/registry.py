"""Queries by name, each with the DuckDB SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from runlake.plans.fixtures import sql_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, views: tuple[str, ...] = ("runs_events",)):
    """Registers a query under its function's name; `sql` follows the WITH clauses of `views`."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH {', '.join(sql_of(v) for v in views)} {sql}" if views else sql
        return f

    return add
