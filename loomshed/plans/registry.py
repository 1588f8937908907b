"""Queries over the driver tables, one per operator, with their DuckDB twins.

The test data holds no camera footage, so every operator runs by role
substitution: ``lineitem`` stands in for frames (order = clip, line number =
frame number), ``orders`` for declared clips, ``events`` for logs, and so on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Add a query under ``name``, with its SQL twin if it has one."""

    def add(fn):
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def _load() -> None:
    """Import the modules that register queries."""
    from loomshed.plans import audits, codes, frames, frames_tiled, gates_reports, live, planes, planning, records, sources, verbs  # noqa: F401
