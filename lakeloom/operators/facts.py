"""Calculated facts: expressions whose names come from the rows, column aliases or lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..expr.compiler import add_expressions
from ..expr.parser import columns_of, parse
from .joins import bind, enrich


def calculated_fact(df: DataFrame, expressions: Mapping[str, str], lookups: Mapping[str, Mapping] | None = None, aliases: Mapping[str, str] | None = None, order: Sequence[str] = ()) -> DataFrame:
    """``df`` with named expressions. A name in them is a column, an alias of one, ``lookup.column``, or the one lookup column of that name.

    ``lookups``: {frame, keys} by alias; only those that a name needs are joined, many to one, and only for the columns it needs.
    """
    lookups, aliases = lookups or {}, aliases or {}
    wanted = set().union(*(columns_of(parse(text)) for text in expressions.values())) - set(expressions)
    known = {alias: [c for c in spec["frame"].columns] for alias, spec in lookups.items()}
    bound = {name: bind(name, df.columns, aliases, known) for name in sorted(wanted)}
    names = list(df.columns)
    for alias, spec in lookups.items():
        needed = sorted({target.partition(".")[2] for target in bound.values() if target not in names and target.startswith(f"{alias}.")})
        if needed:
            keys = spec["keys"] if isinstance(spec["keys"], Mapping) else {k: k for k in spec["keys"]}
            frame = spec["frame"].select(*[F.col(f"`{k}`") for k in keys.values()], *[F.col(f"`{c}`").alias(f"{alias}.{c}") for c in needed])
            df = enrich(df, frame, keys, [f"{alias}.{c}" for c in needed])
    df = df.withColumns({name: F.col(f"`{target}`") for name, target in bound.items() if name != target})
    return add_expressions(df, dict(expressions), order).select(*[f"`{c}`" for c in names if c not in expressions], *[f"`{c}`" for c in expressions])
