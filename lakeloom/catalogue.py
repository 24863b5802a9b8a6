"""Registered queries of the engine's own operators, with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .queries import QUERIES, datasets, operators, scalars, windows  # noqa: F401  the modules register themselves


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: function for name, (function, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
