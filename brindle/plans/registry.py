"""Where plans register their query and its SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def plan(sql: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) under its own name, with SQL that makes the same rows."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.strip()
        return f

    return add
