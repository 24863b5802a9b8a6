"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = 1 << 20


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``. Where that is unset, a temporary folder is set, but only if driver and executors are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="lakeloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/lakeloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: lineage ends there, and a lost executor costs no recomputation.

    ``parts``: at most so many files, for tables whose size is known to need no more.
    """
    path = shared_dir(df.sparkSession, name)
    df = df.coalesce(parts) if parts else df
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: int | None = None) -> Iterator[None]:
    """While jobs run inside, an Arrow batch to a Python worker ends at ``size`` bytes (``BATCH_BYTES``), or sooner where the session says so.

    An executor holds each batch outside its heap, in buffers grown by doubling, and once more in the worker. Only jobs that
    run inside are meant: a lazy result that leaves must be materialised first. The session's own setting is back afterwards.
    """
    key, size = "spark.sql.execution.arrow.maxBytesPerBatch", size or BATCH_BYTES
    own = spark.conf.get(key)
    if 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(own) <= size:
        yield
        return
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, own)


def source_bytes(df: DataFrame) -> int:
    """Bytes of the tables that ``df`` reads, as Catalyst knows them (file sizes): metadata only, no job. Sources of unknown size count as 0."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return sum(size for size in sizes if size < 1 << 55)


def partitions_for(df: DataFrame, mb: int = 16) -> int:
    """Shuffle partitions so that each gets about ``mb`` MB of the source, and never fewer than the session asks for."""
    asked = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(asked, source_bytes(df) // (mb << 20) + 1)


def clear(spark: SparkSession) -> None:
    """Deletes the intermediate tables of this application, no other's; call it when no result of these operators is still to be read."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/lakeloom/{spark.sparkContext.applicationId}")
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
