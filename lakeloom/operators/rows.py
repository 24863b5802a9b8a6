"""Row selection within groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sort_column(key: str | Mapping) -> Column:
    """A key: a name, or {column, direction: asc/desc, nulls: first/last}; nulls come last by default."""
    key = {"column": key} if isinstance(key, str) else key
    column = F.col(f"`{key['column']}`")
    descending, first = key.get("direction", "asc") == "desc", key.get("nulls", "last") == "first"
    if descending:
        return column.desc_nulls_first() if first else column.desc_nulls_last()
    return column.asc_nulls_first() if first else column.asc_nulls_last()


def sort_first(df: DataFrame, group: Sequence[str], sort: Sequence[str | Mapping] = (), ties: Sequence[str | Mapping] = ()) -> DataFrame:
    """First row of each group. Ties go by ``ties``, or by the row's place in its source file. The rank is pushed below the shuffle, so a hot group sends one row a task."""
    order = [sort_column(k) for k in (*sort, *ties)]
    if not ties:
        df = df.withColumn("_lk_row", F.monotonically_increasing_id())
        order.append(F.col("_lk_row"))
    first = Window.partitionBy(*[f"`{g}`" for g in group]).orderBy(*order)
    return df.withColumn("_lk_n", F.row_number().over(first)).filter("_lk_n = 1").drop("_lk_n", "_lk_row")


def all_rows(df: DataFrame) -> DataFrame:
    return df


def dedupe_per_file(df: DataFrame, keys: Sequence[str], sort: Sequence[str | Mapping]) -> DataFrame:
    """First row of each key within each source file (the frame must be a file scan); nulls sort lowest."""
    lowest = [{"column": k, "nulls": "first"} if isinstance(k, str) else {"nulls": "last" if k.get("direction") == "desc" else "first"} | k for k in sort]
    tagged = df.select("*", F.col("_metadata.file_path").alias("_lk_file"), F.col("_metadata.row_index").alias("_lk_at"))
    out = sort_first(tagged, ["_lk_file", *keys], lowest, ["_lk_at"])
    return out.drop("_lk_file", "_lk_at")


def natural_key(text: Column) -> Column:
    """Sort key in which runs of digits, padded to 20, sort as numbers."""
    parts = F.regexp_extract_all(text, F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^[0-9]"), F.lpad(x, 20, "0")).otherwise(x)), "")


def preview(df: DataFrame, n: int = 20) -> DataFrame:
    return df.limit(n)
