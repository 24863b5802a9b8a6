"""Registered queries: every operator and function over the driver's tables, with DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..expr.compiler import add_expressions

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None = None):
    """Decorator: adds a query and, where SQL can say it, its DuckDB text."""

    def add(function):
        QUERIES[name] = (function, sql)
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, for comparison across engines."""
    return df.select(*[F.round(F.col(f"`{c}`"), places).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])


def calculated(name: str, source: str, keep: Sequence[str], expressions: Mapping[str, str], sql: str, order: Sequence[str] = (), exact: bool = False) -> None:
    """Registers a query of ``keep`` and named expressions over one table. ``sql``: the DuckDB query. Doubles are rounded unless ``exact``."""

    def run(spark, sf_dir):
        out = add_expressions(table(spark, sf_dir, source), dict(expressions), order).select(*keep, *expressions)
        return out if exact else rounded(out)

    QUERIES[name] = (run, sql)
