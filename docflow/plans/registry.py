"""Queries by name, each with the DuckDB SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a query under its function's name."""

    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return keep
