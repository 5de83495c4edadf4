"""Queries by name, with the operators that each covers and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from roomflow.plans.tables import ROOMS_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
COVERS: dict[str, tuple[str, ...]] = {}


def query(covers: str, sql: str | None = None, rooms: bool = True) -> Callable[[Query], Query]:
    """Registers a query; ``rooms`` puts the room rows before the SQL as a table of that name."""
    def add(f: Query) -> Query:
        name = f.__name__
        QUERIES[name], COVERS[name] = f, tuple(covers.split())
        if sql:
            text = sql.strip()
            if rooms:
                text = f"WITH rooms AS ({ROOMS_SQL}), {text[5:]}" if text.upper().startswith("WITH ") else f"WITH rooms AS ({ROOMS_SQL}) {text}"
            ORACLE_SQL[name] = text
        return f

    return add
