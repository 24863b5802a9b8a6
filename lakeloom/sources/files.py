"""Parquet and delimited files, and paths that definitions name."""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import check_types, union_by_name
from ..operators.project import grouped_cast

#: Folders that hold no data parts.
HIDDEN = ("_lakeloom", ".temp", "_temporary")


def hadoop(spark: SparkSession, path: str):
    """File system and path object of ``path``."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def discover(spark: SparkSession, paths: Sequence[str], pattern: str = "*.parquet") -> list[str]:
    """Files below ``paths`` that match ``pattern``, sorted; hidden folders are skipped."""
    found = set()
    for path in paths:
        fs, where = hadoop(spark, path)
        files = fs.listFiles(where, True)
        while files.hasNext():
            name = files.next().getPath().toString()
            if fnmatch.fnmatch(name.rsplit("/", 1)[-1], pattern) and not any(f"/{h}/" in name for h in HIDDEN):
                found.add(name)
    return sorted(found)


def read_parquet(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Parquet of one schema."""
    return spark.read.parquet(*paths)


def read_parquet_union(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Parquet files united by name: equal names need equal types, missing columns are null. Files of one schema are read together."""
    by_schema: dict[str, list[str]] = {}
    for path in paths:
        by_schema.setdefault(spark.read.parquet(path).schema.json(), []).append(path)
    frames = [spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(*members) for schema, members in by_schema.items()]
    check_types(frames)
    return union_by_name(frames)


def resolve(spark: SparkSession, source: Mapping, outputs: Mapping[str, str] | None = None) -> list[str]:
    """Paths of a source: literal ``paths``, or ``asset``, whose output root ``outputs`` knows."""
    if "paths" in source:
        return discover(spark, source["paths"], source.get("pattern", "*.parquet"))
    if source.get("asset") not in (outputs or {}):
        raise ValueError(f"unknown asset {source.get('asset')!r}")
    return discover(spark, [outputs[source["asset"]]])


def select_labels(catalog: Sequence[Mapping], labels: Mapping[str, Sequence[str]]) -> list[str]:
    """Paths of catalog entries whose labels have, for each name, one of the wanted values."""
    return sorted(e["path"] for e in catalog if all(str(e.get("labels", {}).get(k)) in [str(v) for v in vs] for k, vs in labels.items()))


def read_csv(
    spark: SparkSession, paths: Sequence[str], delimiter: str = ",", quote: str = '"', header: bool = True, column_names: Sequence[str] | None = None,
    null_values: Sequence[str] = ("",), encoding: str = "UTF-8", casts: Mapping[str, Sequence[str]] | None = None, provenance: bool = True, multi_line: bool = False,
) -> DataFrame:
    """Delimited text, read as text (a malformed row is an error), then cast by group, by name, or not at all.

    ``multi_line``: quoted values may hold line breaks; a file is then read by one task, else it is split. Files with a header must
    have the same one (an error on the executors). Provenance adds file_name, source_modified_at and source_created_at (unknown to Spark, so null).
    """
    options = {"sep": delimiter, "quote": quote, "encoding": encoding, "mode": "FAILFAST", "multiLine": str(multi_line).lower(), "escape": quote}
    names = list(column_names or [])
    if not names:
        if not header:
            raise ValueError("a file without header needs column_names")
        names = spark.read.options(**options, header="true").csv(paths[0]).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = spark.read.options(**options, header=str(header).lower(), enforceSchema="false" if header and not column_names else "true").schema(schema).csv(list(paths))
    if provenance:
        df = df.select("*", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("source_modified_at"), F.lit(None).cast("timestamp_ntz").alias("source_created_at"))
    df = df.withColumns({n: F.when(~F.col(f"`{n}`").isin(list(null_values)), F.col(f"`{n}`")) for n in names})
    if casts is not None:
        own = grouped_cast(df.select(*[f"`{n}`" for n in names]), casts)
        wanted = {f.name: f.dataType for f in own.schema.fields}
        df = df.withColumns({n: F.col(f"`{n}`").cast(t) for n, t in wanted.items()})
    return df


def read_lookup(spark: SparkSession, path: str, fields: Sequence[str]) -> DataFrame:
    """Named fields of a CSV or Parquet lookup."""
    df = spark.read.parquet(path) if path.endswith(".parquet") else read_csv(spark, [path], provenance=False)
    return df.select(*[f"`{f}`" for f in fields])
