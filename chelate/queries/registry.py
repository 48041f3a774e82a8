"""Collects a module's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict, dict[str, str], Callable]:
    queries: dict = {}
    oracles: dict[str, str] = {}

    def query(sql: str | None = None):
        def register(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return register

    return queries, oracles, query
