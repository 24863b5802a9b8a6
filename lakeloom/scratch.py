"""Folders that driver and executors share, for tables that a query writes and reads again."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``, else below the warehouse, both of which a cluster shares."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/lakeloom-scratch/{name}-{uuid.uuid4().hex}"
