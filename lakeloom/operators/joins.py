"""Joins, lookups, key spaces and unions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOW = {"inner": "inner", "left": "left", "right": "right", "full": "full", "cross": "cross", "semi": "left_semi"}


def right_columns(right: DataFrame, keys: Sequence[str], include: Sequence[str] | None = None, exclude: Sequence[str] = (), regex: str | None = None, exclude_regex: str | None = None) -> list[str]:
    """Columns of the right side that a join adds; keys can't be excluded and never appear twice."""
    if wrong := set(exclude) & set(keys):
        raise ValueError(f"join keys can't be excluded: {sorted(wrong)}")
    names = [c for c in right.columns if c not in keys]
    if include is not None:
        if missing := [c for c in include if c not in right.columns]:
            raise ValueError(f"missing columns: {missing}")
        names = [c for c in include if c not in keys]
    names = [c for c in names if c not in exclude]
    if regex:
        names = [c for c in names if re.search(regex, c)]
    return [c for c in names if not (exclude_regex and re.search(exclude_regex, c))]


def join(left: DataFrame, right: DataFrame, keys: Sequence[str] | Mapping[str, str] = (), how: str = "inner", suffix: str = "_right", **columns) -> DataFrame:
    """Equi-join on keys (names, or left: right names) of equal types; null keys never match. The left keys are kept and,
    in right and full joins, filled from the right. A right column takes ``suffix`` only where its name is taken."""
    if how not in HOW:
        raise ValueError(f"unknown join {how!r}")
    pairs = dict(keys) if isinstance(keys, Mapping) else {k: k for k in keys}
    if how == "cross":
        if pairs:
            raise ValueError("a cross join takes no keys")
    elif not pairs:
        raise ValueError("a join needs keys")
    for a, b in pairs.items():
        x, y = left.schema[a].dataType, right.schema[b].dataType
        if x != y:
            raise ValueError(f"key types differ: {a} is {x.simpleString()}, {b} is {y.simpleString()}")
        if isinstance(x, (T.ArrayType, T.StructType, T.MapType)):
            raise ValueError(f"nested join key: {a}")
    names = right_columns(right, list(pairs.values()), **columns) if how != "semi" else []
    target = {c: c + suffix if c in left.columns else c for c in names}
    if clash := [n for n in target.values() if list(target.values()).count(n) > 1 or (n in left.columns)]:
        raise ValueError(f"columns clash: {sorted(set(clash))}")
    key_names = {b: f"_lk_key_{i}" for i, b in enumerate(pairs.values())}
    other = right.select(*[F.col(f"`{b}`").alias(k) for b, k in key_names.items()], *[F.col(f"`{c}`").alias(t) for c, t in target.items()])
    if how == "cross":
        return left.crossJoin(other)
    test = [left[f"`{a}`"] == other[key_names[b]] for a, b in pairs.items()]
    out = left.join(other, test, HOW[how])
    if how in ("right", "full"):
        out = out.withColumns({a: F.coalesce(F.col(f"`{a}`"), F.col(key_names[b])) for a, b in pairs.items()})
    return out.drop(*key_names.values()) if how != "semi" else out


def multi_join(left: DataFrame, steps: Sequence[Mapping]) -> DataFrame:
    """Joins one after another: each step has ``right`` and the arguments of ``join``."""
    for step in steps:
        left = join(left, **step)
    return left


def enrich(df: DataFrame, lookup: DataFrame, keys: Sequence[str] | Mapping[str, str], columns: Sequence[str]) -> DataFrame:
    """Many-to-one left join; a lookup key that occurs twice (nulls aside) is an error."""
    pairs = dict(keys) if isinstance(keys, Mapping) else {k: k for k in keys}
    right = list(pairs.values())
    whole = lookup.na.drop(subset=right)
    once = whole.groupBy(*right).agg(F.count("*").alias("_lk_n"), *[F.first(f"`{c}`").alias(c) for c in columns])
    # the check sits on a key, which the join always reads, whatever columns are read after it
    checked = once.withColumn(right[0], F.when(F.col("_lk_n") == 1, F.col(f"`{right[0]}`")).otherwise(F.raise_error(F.lit("lookup key is not unique")))).select(*[f"`{c}`" for c in (*right, *columns)])
    return join(df, checked, pairs, "left", suffix="_lookup")


def check_types(frames: Sequence[DataFrame]) -> dict[str, T.DataType]:
    """Types by name over several frames; one name with two types is an error."""
    types: dict[str, T.DataType] = {}
    for df in frames:
        for field in df.schema.fields:
            known = types.setdefault(field.name, field.dataType)
            if known != field.dataType:
                raise ValueError(f"column {field.name} is {known.simpleString()} and {field.dataType.simpleString()}")
    return types


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name with strictly equal types; what a member lacks is null."""
    check_types(frames)
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def union_rows(members: Mapping[str, DataFrame], identity: str) -> DataFrame:
    """Union of named members with their name in column ``identity``."""
    if taken := [n for n, df in members.items() if identity in df.columns]:
        raise ValueError(f"column {identity} exists in {taken}")
    return union_by_name([df.withColumn(identity, F.lit(name)) for name, df in members.items()])


def keyspace(members: Sequence[DataFrame], keys: Sequence[str], nulls: str = "error") -> DataFrame:
    """Distinct key tuples over all members; null keys are dropped or an error."""
    parts = [df.select(*keys) for df in members]
    check_types(parts)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    if nulls == "drop":
        return out.na.drop(subset=list(keys)).distinct()
    first, *rest = keys
    bad = F.col(first).isNull()
    for k in rest:
        bad = bad | F.col(k).isNull()
    # the check sits on the key column itself, so no optimisation can drop it
    return out.withColumn(first, F.when(bad, F.raise_error(F.lit("null key in keyspace"))).otherwise(F.col(first))).distinct()


def bind(name: str, columns: Sequence[str], aliases: Mapping[str, str], lookups: Mapping[str, Sequence[str]]) -> str:
    """Where a leaf name comes from: a source column, a column alias, ``lookup.column``, or the one lookup column of that name."""
    if name in columns:
        return name
    if name in aliases and aliases[name] in columns:
        return aliases[name]
    alias, _, column = name.partition(".")
    if column and column in lookups.get(alias, ()):
        return name
    found = [f"{a}.{name}" for a, names in lookups.items() if name in names]
    if len(found) == 1:
        return found[0]
    raise ValueError(f"{name} is {'ambiguous' if found else 'unknown'}")
