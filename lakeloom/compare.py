"""Equality of datasets as multisets of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summary(df: DataFrame) -> DataFrame:
    """One row: count, order-free hash of all rows, nulls by column, duplicated rows. Columns go by name, so their order doesn't matter."""
    columns = [F.col(f"`{c}`") for c in sorted(df.columns)]
    digest = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    part = [F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(2)]
    rows = df.select(digest.alias("d"), *[p.alias(f"h{i}") for i, p in enumerate(part)], F.array(*[c.isNull().cast("long") for c in columns]).alias("nulls"))
    groups = rows.groupBy("d").agg(F.count("*").alias("n"), F.first("h0").alias("h0"), F.first("h1").alias("h1"), *[F.sum(F.col("nulls")[i]).alias(f"null_{c}") for i, c in enumerate(sorted(df.columns))])
    modulus = F.lit(10**15).cast("decimal(38,0)")
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"),
        *[(F.coalesce(F.sum((F.col(h) * F.col("n")) % modulus), F.lit(0)) % modulus).cast("long").alias(f"hash_{h}") for h in ("h0", "h1")],
        *[F.coalesce(F.sum(f"null_{c}"), F.lit(0)).alias(f"null_{c}") for c in sorted(df.columns)],
    )


def compare(left: DataFrame, right: DataFrame) -> dict:
    """Whether two datasets have equal schemas (by name) and equal rows, with both summaries."""
    schemas = [{f.name: f.dataType.simpleString() for f in df.schema.fields} for df in (left, right)]
    out: dict = {"schema_equal": schemas[0] == schemas[1]}
    if out["schema_equal"]:
        a, b = (summary(df).first().asDict() for df in (left, right))
        out |= {"left": a, "right": b, "equal": a == b}
    else:
        out |= {"equal": False, "only_left": sorted(set(schemas[0].items()) - set(schemas[1].items())), "only_right": sorted(set(schemas[1].items()) - set(schemas[0].items()))}
    return out


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has more often, with ``side``."""
    right = right.select(*left.columns)
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
