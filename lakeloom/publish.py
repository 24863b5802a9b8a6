"""Publication of committed datasets as immutable generations, key indexes for point lookups, and a log of runs."""

from __future__ import annotations

import json
import time
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import _write_text, read_manifest
from .sources.files import hadoop

POINTERS = "pointers"


def _read(spark: SparkSession, path: str) -> dict | None:
    fs, where = hadoop(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def publish(spark: SparkSession, root: str, target: str, expected: str | None = None) -> dict:
    """Copies the dataset's generation below ``target`` and moves the pointer.

    If the pointer isn't at ``expected`` (when given), or another publisher moves it meanwhile, the pointer stays and an error is raised.
    """
    manifest = read_manifest(spark, root)
    if manifest is None:
        raise ValueError(f"{root} has no committed dataset")
    number, now = _pointer(spark, target)
    if expected is not None and now != expected:
        raise ValueError(f"{target} is at {now}, not {expected}")
    generation = manifest["generation"]
    fs, where = hadoop(spark, f"{target}/generations/{generation}")
    if not fs.exists(where):
        source_fs, source = hadoop(spark, root)
        part = f"{target}/generations/.part-{generation}"
        part_fs, part_path = hadoop(spark, part)
        part_fs.delete(part_path, True)
        spark._jvm.org.apache.hadoop.fs.FileUtil.copy(source_fs, source, part_fs, part_path, False, spark._jsc.hadoopConfiguration())
        fs.mkdirs(where.getParent())
        fs.rename(part_path, where)
    # pointers are numbered and never overwritten: of two publishers that saw the same one, one creates the next
    fs, pointer = hadoop(spark, f"{target}/{POINTERS}/{number + 1:012d}.json")
    fs.mkdirs(pointer.getParent())
    try:
        out = fs.create(pointer, False)
    except Exception as error:
        if fs.exists(pointer):
            raise ValueError(f"{target} was published to meanwhile") from error
        raise
    out.write(bytearray(json.dumps({"generation": generation, "previous": now}).encode()))
    out.close()
    return {"generation": generation, "previous": now}


def _pointer(spark: SparkSession, target: str) -> tuple[int, str | None]:
    """Number and generation of the newest pointer that is written in full."""
    fs, where = hadoop(spark, f"{target}/{POINTERS}")
    names = sorted((s.getPath().getName() for s in fs.listStatus(where)), reverse=True) if fs.exists(where) else []
    for name in names:
        try:
            found = _read(spark, f"{target}/{POINTERS}/{name}")
        except ValueError:
            continue
        if found:
            return int(name.split(".")[0]), found["generation"]
    return 0, None


def current(spark: SparkSession, target: str) -> str | None:
    return _pointer(spark, target)[1]


def read(spark: SparkSession, target: str, generation: str | None = None) -> DataFrame:
    return spark.read.parquet(f"{target}/generations/{generation or current(spark, target)}")


def collect_garbage(spark: SparkSession, target: str, keep: Sequence[str] = ()) -> list[str]:
    """Deletes generations other than the current one and those to keep."""
    fs, where = hadoop(spark, f"{target}/generations")
    gone, stay = [], {current(spark, target), *keep}
    for status in fs.listStatus(where):
        name = status.getPath().getName()
        if name not in stay:
            fs.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)


def build_key_index(spark: SparkSession, root: str, keys: Sequence[str], path: str, buckets: int = 64) -> None:
    """(bucket, key_hash, file, row) of every row, by bucket of the hash: a lookup reads one bucket."""
    df = spark.read.parquet(root)
    hashed = F.xxhash64(*[F.col(f"`{k}`") for k in keys])
    index = df.select(hashed.alias("key_hash"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    index = index.withColumn("bucket", F.pmod("key_hash", F.lit(buckets)).cast("int"))
    index.repartition("bucket").sortWithinPartitions("bucket", "key_hash").write.mode("overwrite").partitionBy("bucket").parquet(path)


def lookup(spark: SparkSession, root: str, index: str, key: Mapping, buckets: int = 64) -> DataFrame:
    """Rows of one key: its bucket gives the files, and only these are read, with the key pushed down."""
    types = {f.name: f.dataType for f in spark.read.parquet(root).schema.fields}
    literals = [F.lit(v).cast(types[k]) for k, v in key.items()]
    wanted = spark.range(1).select(F.xxhash64(*literals).alias("h")).first().h
    files = [r.file for r in spark.read.parquet(index).filter((F.col("bucket") == wanted % buckets) & (F.col("key_hash") == wanted)).select("file").distinct().collect()]
    test = F.lit(True)
    for (name, _), value in zip(key.items(), literals, strict=True):
        test = test & F.col(f"`{name}`").eqNullSafe(value)
    whole = spark.read.parquet(root)
    if not files:
        return whole.limit(0)
    return spark.read.schema(whole.schema).option("basePath", root).parquet(*files).filter(test)


class RunLog:
    """One JSON file for each run, so that runs on different machines never write to the same file."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def record(self, name: str, status: str, **details) -> None:
        at = time.time_ns()
        _write_text(self.spark, f"{self.path}/{at}-{name}.json", json.dumps({"at": at, "name": name, "status": status, "details": json.dumps(details, sort_keys=True, default=str)}))

    def read(self) -> DataFrame:
        return self.spark.read.schema("at long, name string, status string, details string").json(self.path)
