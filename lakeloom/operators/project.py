"""Filters, projections, casts and calculated columns."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..expr.compiler import add_expressions, condition
from ..types import spark_type


def filter_sql(df: DataFrame, sql: str) -> DataFrame:
    """Rows for which a SQL condition is true; brackets, ``~=`` and ``//`` belong to the expression language and are refused."""
    for mark in ("[", "]", "~=", "//"):
        if mark in re.sub(r"'(?:[^']|'')*'", "", sql):
            raise ValueError(f"{mark!r} is not part of the SQL subset")
    return df.filter(sql)


def filter_expression(df: DataFrame, expression: str, order: Sequence[str] = ()) -> DataFrame:
    return condition(df, expression, order)


def thin_condition(tree: Mapping) -> Column:
    """Filter tree of and, or, eq, ne, in, like, is_null, is_not_null. Values compare as text; ne holds for null; an unknown operator never holds."""
    op = tree.get("op")
    if op in ("and", "or"):
        parts = [thin_condition(t) for t in tree["args"]]
        return reduce((lambda a, b: a & b) if op == "and" else (lambda a, b: a | b), parts, F.lit(op == "and"))
    if op not in ("eq", "ne", "in", "like", "is_null", "is_not_null"):
        return F.lit(False)
    column = F.col(f"`{tree['column']}`").cast("string")
    if op == "is_null":
        return column.isNull()
    if op == "is_not_null":
        return column.isNotNull()
    if op == "in":
        return F.coalesce(column.isin([str(v) for v in tree["values"]]), F.lit(False))
    value = F.lit(None if tree.get("value") is None else str(tree["value"]))
    if op == "eq":
        return F.coalesce(column == value, F.lit(False))
    if op == "ne":
        return ~column.eqNullSafe(value)
    return F.coalesce(column.like(str(tree["value"])), F.lit(False))


def filter_thin(df: DataFrame, tree: Mapping) -> DataFrame:
    return df.filter(thin_condition(tree))


def include_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Ordered selection; a missing column is an error."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*[f"`{c}`" for c in columns])


def exclude_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def rename_columns(df: DataFrame, mapping: Mapping[str, str] | None = None, rules: Sequence[Mapping] = (), unmatched: str = "ignore") -> DataFrame:
    """``mapping`` first, then the first regex rule (pattern, replacement, ignore_case) that matches a name as a whole."""
    mapping = dict(mapping or {})
    if missing := [c for c in mapping if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    used = set()
    for name in df.columns:
        for i, rule in enumerate(rules):
            flags = re.IGNORECASE if rule.get("ignore_case") else 0
            if name not in mapping and (m := re.fullmatch(rule["pattern"], name, flags)):
                mapping[name] = m.expand(rule["replacement"])
                used.add(i)
    if unmatched == "error" and len(used) < len(rules):
        raise ValueError(f"rename rules without a match: {[rules[i]['pattern'] for i in range(len(rules)) if i not in used]}")
    new = [mapping.get(c, c) for c in df.columns]
    if len(set(new)) < len(new):
        raise ValueError(f"renaming gives one name twice: {sorted({n for n in new if new.count(n) > 1})}")
    return df.withColumnsRenamed(mapping)


def project(df: DataFrame, fields: Sequence[Mapping]) -> DataFrame:
    """Fields {name, source, dtype, allow_missing}: a missing source is null where allowed, else an error."""
    out = []
    for field in fields:
        source, kind = field.get("source", field["name"]), field.get("dtype")
        if source not in df.columns:
            if not field.get("allow_missing"):
                raise ValueError(f"missing column: {source}")
            column = F.lit(None).cast(spark_type(kind) if kind else "string")
        else:
            column = F.col(f"`{source}`")
            column = column.cast(spark_type(kind)) if kind else column
        out.append(column.alias(field["name"]))
    return df.select(*out)


def type_cast(df: DataFrame, casts: Sequence[Mapping], strict: bool = True) -> DataFrame:
    """Casts {name, type}; a value that doesn't fit is an error if ``strict``, else null. The first cast of a name counts; casts to a column's own type are skipped."""
    wanted: dict[str, Column] = {}
    for cast in casts:
        name, kind = cast["name"], spark_type(cast["type"])
        if name not in df.columns:
            raise ValueError(f"missing column: {name}")
        if name not in wanted and df.schema[name].dataType != kind:
            column = F.col(f"`{name}`")
            wanted[name] = column.cast(kind) if strict else column.try_cast(kind)
    return df.withColumns(wanted) if wanted else df


#: Types that column names imply (fixed values): a whole name, and a part of one.
NAME_TYPES = {"wafer_id": "int64"}
PART_TYPES = {"time": "datetime"}


def name_rule(name: str) -> str | None:
    """Type that a column's name implies."""
    lower = name.lower()
    return NAME_TYPES.get(lower) or next((kind for part, kind in PART_TYPES.items() if part in lower), None)


def grouped_cast(df: DataFrame, groups: Mapping[str, Sequence[str]], default: str = "string") -> DataFrame:
    """Casts of all columns: an explicit group {type: columns}, else what the name implies, else ``default``."""
    explicit = {c: kind for kind, columns in groups.items() for c in columns}
    return type_cast(df, [{"name": c, "type": explicit.get(c) or name_rule(c) or default} for c in df.columns])


def add_calc(df: DataFrame, expressions: Mapping[str, str], order: Sequence[str] = ()) -> DataFrame:
    """Named expressions, layered by dependency."""
    return add_expressions(df, dict(expressions), order)


def reference_replace(df: DataFrame, column: str, lookup: DataFrame, old: str, new: str) -> DataFrame:
    """Replaces values, as text, by a lookup; unknown values stay, null stays null, a duplicate key is an error."""
    pairs = lookup.select(F.col(f"`{old}`").cast("string").alias("_lk_old"), F.col(f"`{new}`").cast("string").alias("_lk_new")).filter("_lk_old is not null")
    unique = pairs.groupBy("_lk_old").agg(F.first("_lk_new").alias("_lk_new"), F.count("*").alias("_lk_n"))
    checked = unique.select("_lk_old", F.when(F.col("_lk_n") == 1, F.col("_lk_new")).otherwise(F.raise_error(F.concat(F.lit("duplicate reference key "), "_lk_old"))).alias("_lk_new"))
    text = F.col(f"`{column}`").cast("string")
    return df.join(checked, text == F.col("_lk_old"), "left").withColumn(column, F.coalesce("_lk_new", text)).drop("_lk_old", "_lk_new")


def resolve_aliases(names: Sequence[str], columns: Sequence[str], registry: Mapping[str, Sequence[str]]) -> dict[str, str]:
    """Column for each wanted name: itself, or the first registered alias that the input has."""
    out = {}
    for name in names:
        found = [c for c in (name, *registry.get(name, ())) if c in columns]
        if found:
            out[name] = found[0]
    return out
