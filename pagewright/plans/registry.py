"""Where query plans register themselves with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a plan (spark, sf_dir) -> DataFrame under its name; sql: the same for DuckDB, where SQL can express it."""

    def add(plan: Callable) -> Callable:
        QUERIES[plan.__name__] = plan
        if sql:
            ORACLE_SQL[plan.__name__] = sql
        return plan

    return add
