"""The library's queries and their SQL by name."""

from __future__ import annotations

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add
