"""Writers: partitioned datasets with a manifest, routes, append segments and single-file snapshots."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators.project import filter_expression
from .sources.files import discover, hadoop

MANIFEST = "_dataset.manifest.json"


def partition_value(column):
    """A partition's folder name: null and empty text get names, characters that paths can't hold become ``_``."""
    text = column.cast("string")
    return F.when(text.isNull(), "__null__").when(text == "", "__empty__").otherwise(F.regexp_replace(text, r'[/\\:*?"<>|]', "_"))


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, where = hadoop(spark, path)
    out = fs.create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_manifest(spark: SparkSession, root: str) -> dict | None:
    fs, where = hadoop(spark, f"{root}/{MANIFEST}")
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _parts(spark: SparkSession, root: str, schema: T.StructType) -> dict[str, dict]:
    """Rows, size and a hash of the rows (in any order) of each part, counted on the executors as column batches: no part is held whole."""
    files = discover(spark, [root])
    if not files:
        return {}
    fs, where = hadoop(spark, root)
    base = fs.resolvePath(where).toString().rstrip("/") + "/"
    df = spark.read.schema(schema).parquet(*files)
    values = [F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`") for f in schema.fields]
    one, two = F.xxhash64(F.lit(0), *values), F.xxhash64(F.lit(1), *values)
    by = df.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
    found = by.agg(F.count("*").alias("n"), F.sum(one.cast("decimal(38,0)")).alias("a"), F.bit_xor(two).alias("b")).collect()  # a row for each part
    parts = {name.removeprefix(base): {"bytes": None, "rows": 0, "content": "0"} for name in files}
    for r in found:
        name = r.path if r.path.removeprefix(base) in parts else unquote(r.path)
        parts[name.removeprefix(base)] = {"bytes": r.bytes, "rows": r.n, "content": hashlib.sha256(f"{r.n}:{r.a}:{r.b}".encode()).hexdigest()}
    return parts


def change_receipt(old: Mapping | None, new: Mapping) -> dict:
    """Added, replaced, removed and unchanged parts between two manifests."""
    a, b = (old or {}).get("parts", {}), new["parts"]
    both = set(a) & set(b)
    return {
        "generation": new["generation"], "previous": (old or {}).get("generation"),
        "added": sorted(set(b) - set(a)), "removed": sorted(set(a) - set(b)),
        "replaced": sorted(p for p in both if a[p]["content"] != b[p]["content"]), "unchanged": sorted(p for p in both if a[p]["content"] == b[p]["content"]),
    }


def _staged(spark: SparkSession, stage: str, schema: T.StructType, partition: str | None, kind: T.DataType | None) -> DataFrame:
    """The rows of a stage; folder names of nulls and empty texts are turned back."""
    df = spark.read.schema(schema).parquet(stage)
    if partition is None:
        return df
    name = F.col(f"`{partition}`")
    return df.withColumn(partition, F.when(name == "__empty__", "").when(name != "__null__", name).cast(kind))


def commit(df: DataFrame, root: str, partition: str | None = None, rows_per_file: int = 0, order: Sequence[str] = (), check: Callable[[DataFrame], None] | None = None) -> dict:
    """Writes to a staging folder, adds the manifest, then swaps it with ``root``; a failure leaves the old dataset. Returns the change receipt.

    ``check`` gets the staged rows; if it raises, the stage goes and nothing is swapped.
    """
    spark, generation = df.sparkSession, uuid.uuid4().hex
    stage, backup = f"{root}.stage-{generation}", f"{root}.backup-{generation}"
    kind = None
    if partition is not None:
        kind = df.schema[partition].dataType
        if not isinstance(df.schema[partition].dataType, (T.StringType, T.IntegerType, T.LongType)):
            raise ValueError("a partition column is text or a 32 or 64 bit integer")
        df = df.withColumn("_lk_part", partition_value(F.col(f"`{partition}`"))).drop(partition).withColumnRenamed("_lk_part", partition)
    if order:
        df = df.sortWithinPartitions(*([partition] if partition else []), *order)
    writer = df.write.option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(partition) if partition else writer).parquet(stage)
    fs, target = hadoop(spark, root)
    path = spark._jvm.org.apache.hadoop.fs.Path
    if check:
        try:
            check(_staged(spark, stage, df.schema, partition, kind))
        except Exception:
            fs.delete(path(stage), True)
            raise
    old = read_manifest(spark, root)
    written = T.StructType([f for f in df.schema.fields if f.name != partition])
    manifest = {"generation": generation, "previous": (old or {}).get("generation"), "schema": json.loads(df.schema.json()), "parts": _parts(spark, stage, written)}
    _write_text(spark, f"{stage}/{MANIFEST}", json.dumps(manifest))
    if fs.exists(target) and not fs.rename(target, path(backup)):
        raise OSError(f"can't move {root} away")
    if not fs.rename(path(stage), target):
        fs.rename(path(backup), target)
        raise OSError(f"can't move the new dataset to {root}")
    fs.delete(path(backup), True)
    return change_receipt(old, manifest)


def recover(spark: SparkSession, root: str) -> list[str]:
    """After a crash: a backup without its dataset comes back, other stages and backups go. Returns what was done."""
    fs, target = hadoop(spark, root)
    done = []
    if not fs.exists(target.getParent()):
        return done
    for status in fs.listStatus(target.getParent()):
        name = status.getPath().getName()
        if name.startswith(target.getName() + ".backup-") and not fs.exists(target):
            fs.rename(status.getPath(), target)
            done.append(f"restored {name}")
        elif name.startswith((target.getName() + ".backup-", target.getName() + ".stage-")):
            fs.delete(status.getPath(), True)
            done.append(f"removed {name}")
    return sorted(done)


def route(df: DataFrame, routes: Mapping[str, str]) -> DataFrame:
    """Rows with the name of each route whose expression holds: a row may take several routes, or none and vanish."""
    out = None
    for name, expression in routes.items():
        part = filter_expression(df, expression).withColumn("route", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def write_routes(df: DataFrame, routes: Mapping[str, str], root: str) -> dict[str, dict]:
    return {name: commit(filter_expression(df, expression), f"{root}/{name}") for name, expression in routes.items()}


def write_segment(df: DataFrame, root: str, segment: str) -> None:
    """Appends or replaces one source segment; other segments stay."""
    df.withColumn("segment_id", F.lit(segment)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("segment_id").parquet(root)


def drop_segments(spark: SparkSession, root: str, segments: Sequence[str]) -> None:
    for segment in segments:
        fs, where = hadoop(spark, f"{root}/segment_id={segment}")
        fs.delete(where, True)


def write_snapshot(df: DataFrame, path: str) -> None:
    """One Parquet file: for results that are meant to be small."""
    df.coalesce(1).write.mode("overwrite").parquet(path)


def fingerprint(*values) -> str:
    return hashlib.sha256(json.dumps(values, sort_keys=True, default=str).encode()).hexdigest()
