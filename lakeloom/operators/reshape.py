"""Pivot, unpivot, lists and long facts."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import spark_type

NULL_LABEL = "__null__"
AGGREGATES = ("first", "count", "sum", "avg", "mean", "min", "max", "unique_concatenate")


def _aggregate(name: str, column: Column, order: Column, text: bool = False) -> Column:
    if name not in AGGREGATES:
        raise ValueError(f"unknown aggregate {name!r}")
    if name == "first":
        return F.min_by(column, order)
    if name == "count":
        return F.count(column)
    if name == "sum":
        return F.sum(column.cast("double"))
    if name in ("avg", "mean"):
        return F.avg(column.cast("double"))
    if name in ("min", "max") and text:  # numbers in text compare as numbers where a cell holds nothing else; of equal ones the first stays
        number = column.try_cast("double")
        place = F.when(number.isNotNull(), F.struct((number if name == "min" else -number).alias("n"), order.alias("o")))
        return F.when(F.count(column) == F.count(number), F.min_by(column, place)).otherwise((F.min if name == "min" else F.max)(column))
    if name in ("min", "max"):
        return (F.min if name == "min" else F.max)(column)
    seen = F.collect_list(F.when(column.isNotNull(), F.struct(order.alias("o"), column.cast("string").alias("v"))))
    return F.array_join(F.array_distinct(F.transform(F.sort_array(seen), lambda x: x["v"])), ",")


def pivot(
    df: DataFrame,
    row_keys: Sequence[str],
    column_keys: Sequence[str],
    values: Sequence[Mapping],
    order: Sequence[str],
    plain: Sequence[Mapping] = (),
    null_key: str = "label",
    separator: str = "__",
    name: Sequence[str] = ("<column_key_value>", "<value_key_name>"),
    column_values: Sequence[str] | None = None,
    duplicates: str = "allow",
    most_columns: int = 5000,
) -> DataFrame:
    """Row keys by observed column keys. ``values`` and ``plain`` (without a column key) are {name, agg, dtype}.

    Column names follow ``name``: parts joined by ``separator``. Unless given, the column values are found in one pass and
    come in order of first appearance under ``order``. Counts of missing cells are 0. ``null_key``: ``label`` or ``error``.
    ``duplicates``: ``error`` refuses a cell of a ``first`` value with several rows, ``warn`` warns of how many there are (one more pass).
    """
    if duplicates not in ("allow", "warn", "error"):
        raise ValueError(f"duplicates are allow, warn or error, not {duplicates!r}")
    at = F.struct(*[F.col(f"`{c}`") for c in order])
    text = [F.col(f"`{k}`").cast("string") for k in column_keys]
    if null_key == "error":
        text = [F.when(t.isNull(), F.raise_error(F.lit("null column key in pivot"))).otherwise(t) for t in text]
    df = df.withColumn("_lk_key", F.concat_ws(separator, *[F.coalesce(t, F.lit(NULL_LABEL)) for t in text]))
    if column_values is None:
        found = df.groupBy("_lk_key").agg(F.min(at).alias("o")).orderBy("o").limit(most_columns + 1).collect()
        if len(found) > most_columns:
            raise ValueError(f"pivot would make more than {most_columns} columns")
        column_values = [r._lk_key for r in found]
    if duplicates == "warn" and any(v["agg"] == "first" for v in values):
        twice = df.groupBy(*row_keys, "_lk_key").count().filter("count > 1").count()
        if twice:
            warnings.warn(f"{twice} pivot cells have several rows; the first is taken", stacklevel=2)
    aggs, names = [], []
    for key in column_values:
        here = F.col("_lk_key") == key
        for value in values:
            column = F.col(f"`{value['name']}`")
            if value["agg"] == "first":
                made = F.min_by(F.when(here, column), F.when(here, at))
                if duplicates == "error":
                    made = F.when(F.count(F.when(here, 1)) > 1, F.raise_error(F.lit(f"duplicate cell in pivot column {key}"))).otherwise(made)
            else:
                made = _aggregate(value["agg"], F.when(here, column), at, isinstance(df.schema[value["name"]].dataType, T.StringType))
            if value.get("dtype"):
                made = made.cast(spark_type(value["dtype"]))
            parts = {"<column_key_value>": key, "<value_key_name>": value["name"], "<agg>": value["agg"]}
            names.append(separator.join(parts.get(p, p) for p in name))
            aggs.append(made.alias(names[-1]))
    for value in plain:
        made = _aggregate(value["agg"], F.col(f"`{value['name']}`"), at, isinstance(df.schema[value["name"]].dataType, T.StringType))
        names.append(value.get("as", value["name"]))
        aggs.append((made.cast(spark_type(value["dtype"])) if value.get("dtype") else made).alias(names[-1]))
    if len(set(names)) < len(names) or set(names) & set(row_keys):
        raise ValueError("pivot column names clash")
    return df.groupBy(*row_keys).agg(*aggs)


def unpivot(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "name", value: str = "value", coercion: str | None = None, preserve_nulls: bool = True) -> DataFrame:
    """Rows of (ids, name, value). Columns of one type keep it, mixed numbers become double, others need ``coercion='string'``."""
    types = {df.schema[c].dataType.simpleString(): df.schema[c].dataType for c in columns}
    if len(types) > 1:
        target = "string" if coercion == "string" else "double" if all(isinstance(t, T.NumericType) for t in types.values()) else None
        if target is None:
            raise ValueError(f"columns of different types need coercion: {sorted(types)}")
        df = df.withColumns({c: F.col(f"`{c}`").cast(target) for c in columns})
    out = df.unpivot(list(ids), list(columns), name, value)
    return out if preserve_nulls else out.filter(F.col(f"`{value}`").isNotNull())


def unpivot_remaining(df: DataFrame, ids: Sequence[str], value_type: str, name: str = "name", value: str = "value") -> DataFrame:
    """All columns but the ids, cast to one type."""
    rest = [c for c in df.columns if c not in ids]
    return df.withColumns({c: F.col(f"`{c}`").cast(spark_type(value_type)) for c in rest}).unpivot(list(ids), rest, name, value)


def list_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]


def expand_lists(df: DataFrame, columns: Sequence[str] | None = None, most: int | None = None, position: str | None = None) -> DataFrame:
    """One row for each place of the parallel lists. Null and empty lists vanish, null elements stay; lists of one row must be equally long."""
    columns = list(columns or list_columns(df))
    sizes = [F.coalesce(F.size(f"`{c}`"), F.lit(-1)) for c in columns]
    same = F.lit(True)
    for s in sizes[1:]:
        same = same & (s == sizes[0])
    zipped = F.arrays_zip(*[F.col(f"`{c}`").alias(c) for c in columns])
    zipped = F.when(same, zipped).otherwise(F.raise_error(F.lit("lists of one row differ in length")))
    if most is not None:
        zipped = F.when(sizes[0] <= most, zipped).otherwise(F.raise_error(F.lit(f"a list has more than {most} elements")))
    rest = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    place = position or "_lk_pos"
    out = df.select(*rest, F.posexplode(zipped).alias(place, "_lk_x"))
    out = out.withColumns({c: F.col("_lk_x").getField(c) for c in columns})
    return out.select(*df.columns, *([position] if position else []))


def unnest(df: DataFrame, columns: Sequence[str] | None = None, most: int = 1024) -> DataFrame:
    return expand_lists(df, columns, most)


def _field(structs: str, name: str) -> Column:
    return F.transform(structs, lambda x: x[name])


def compact_lists(expanded: DataFrame, parents: DataFrame, key: str, columns: Sequence[str], position: str) -> DataFrame:
    """The inverse of ``expand_lists``: lists in order of ``position`` on their parents, whose null and empty lists come back."""
    packed = expanded.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(position, *columns))).alias("_lk_list"))
    joined = parents.join(packed, key, "left")
    made = {c: F.when(F.col("_lk_list").isNotNull(), _field("_lk_list", c)).otherwise(F.col(f"`{c}`")) for c in columns}
    return joined.withColumns(made).drop("_lk_list").select(*parents.columns)


def parse_list(column: Column, element: str = "double") -> Column:
    """A JSON text list as an array."""
    return F.from_json(column.cast("string"), f"array<{element}>", {"mode": "FAILFAST"})


def restore_lists(df: DataFrame, lookup: DataFrame, group: str, values: Sequence[str], coords: Sequence[str], order: str, lookup_coords: Sequence[str] | None = None) -> DataFrame:
    """Sparse (values at coordinates) lists as dense lists in the lookup's ``order`` of its group's coordinates.

    Places without a value are null, coordinates that the lookup lacks are ignored; the coordinate columns become the dense
    coordinates. Lists of unequal length and groups that the lookup lacks are errors.
    """
    theirs = list(lookup_coords or coords)
    slots = lookup.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(order, *[F.col(a).alias(b) for a, b in zip(theirs, coords, strict=True)]))).alias("_lk_slots"))
    joined = df.join(slots, group, "left")
    sizes = [F.size(F.col(f"`{c}`")) for c in (*coords, *values)]
    same = F.lit(True)
    for s in sizes[1:]:
        same = same & (s == sizes[0])

    def text(x):
        return F.concat_ws("\u0001", *[x[c].cast("string") for c in coords])

    dense = F.when(F.col("_lk_slots").isNull(), F.raise_error(F.lit("unknown key in list restore"))).when(~same, F.raise_error(F.lit("sparse lists differ in length"))).otherwise(F.transform("_lk_slots", text))
    keys = F.transform(F.arrays_zip(*[F.col(f"`{c}`").alias(c) for c in coords]), text)
    joined = joined.withColumns({"_lk_dense": dense, "_lk_keys": keys})

    def at(values):
        return F.transform("_lk_dense", lambda d: F.get(F.col(f"`{values}`"), F.array_position("_lk_keys", d).cast("int") - 1))

    made = {v: at(v) for v in values} | {c: _field("_lk_slots", c) for c in coords}
    return joined.withColumns(made).select(*df.columns)


#: Lanes of a long fact by type (fixed names).
LANES = {
    "bool": "value_bool", "int": "value_int64", "float": "value_float64", "string": "value_string", "date": "value_date", "timestamp": "value_timestamp", "duration": "value_duration", "decimal": "value_decimal",
    ("list", "bool"): "list_bool", ("list", "int"): "list_int64", ("list", "float"): "list_float64", ("list", "string"): "list_string", ("list", "date"): "list_date", ("list", "timestamp"): "list_timestamp",
}
_LANE_TYPES = {"value_bool": "boolean", "value_int64": "bigint", "value_float64": "double", "value_string": "string", "value_date": "date", "value_timestamp": "timestamp_ntz", "value_duration": "interval day to second", "value_decimal": "decimal(38,10)", "list_bool": "array<boolean>", "list_int64": "array<bigint>", "list_float64": "array<double>", "list_string": "array<string>", "list_date": "array<date>", "list_timestamp": "array<timestamp_ntz>"}


def long_fact(df: DataFrame, identity: Sequence[str], facts: Sequence[str], generation: str = "") -> DataFrame:
    """One row for each (row, fact column), its value in the lane of its type, with the identity's hash and provenance."""
    from ..types import kind_of

    row_hash = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in identity]), {"ignoreNullFields": "false"}), 256)
    parts = []
    for fact in facts:
        kind = kind_of(df.schema[fact].dataType)
        if kind not in LANES:
            raise ValueError(f"no lane for {fact}: {kind}")
        lane = LANES[kind]
        value = {n: (F.col(f"`{fact}`") if n == lane else F.lit(None)).cast(t).alias(n) for n, t in _LANE_TYPES.items()}
        parts.append(F.struct(F.lit(fact).alias("fact_name"), F.lit(lane).alias("value_type"), F.col(f"`{fact}`").isNull().alias("is_null"), *value.values()))
    out = df.select(*[F.col(f"`{c}`") for c in identity], row_hash.alias("identity_hash"), F.explode(F.array(*parts)).alias("_lk_fact"))
    return out.select(*identity, "identity_hash", "_lk_fact.*", F.lit(generation).alias("generation_id"), F.lit(False).alias("is_deleted"))
