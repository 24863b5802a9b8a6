"""Incremental runs over file sources with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def process_new_files(spark: SparkSession, source: str, schema: T.StructType, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, files_per_batch: int = 1000) -> None:
    """Takes each file of a folder once, in bounded batches, and appends what ``transform`` makes of it; then stops.

    The checkpoint remembers the files, and a batch that failed is run again.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").parquet(source)
    query = transform(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
    query.awaitTermination()
