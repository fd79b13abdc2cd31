"""The queries of the reference-side operators, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function of (spark, sf_dir) under its name, with SQL that gives the same rows."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def load() -> None:
    """Import the modules that register queries."""
    from importlib import import_module

    for name in ("tables", "fields", "evidence", "space", "more"):
        import_module(f"chronolens.plans.{name}")
