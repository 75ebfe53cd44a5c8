"""Queries of the library's own operators: name -> (Spark function, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = "benchmark_cells"
_QUERIES: dict[str, tuple[Query, str | None]] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Decorator: adds a query under a name."""

    def add(f: Query) -> Query:
        _QUERIES[name] = (f, sql)
        return f

    return add


def _load() -> None:
    from docquarry.plans import catalog  # noqa: F401  its decorators fill _QUERIES


def queries() -> dict[str, Query]:
    _load()
    return {k: f for k, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: sql for k, (_, sql) in _QUERIES.items() if sql}
