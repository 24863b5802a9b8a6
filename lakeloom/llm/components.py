"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialise

ROWS_PER_PART = 200_000


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); the component is its smallest node.

    Alternates the large-star and small-star steps until the edges stand still. Each step is an
    aggregation with partial minima and an equi-join that can be split where a node is hot; each
    round is cut by a written table. Nulls and loops are dropped; no edges give an empty result.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    pairs = materialise(pairs, "edges")
    parts = max(4, pairs.count() // ROWS_PER_PART)
    for _ in range(most_rounds):
        both = pairs.union(pairs.select(F.col("v"), F.col("u"))).toDF("u", "v")
        low = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low", parts)
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.distinct(), "large", parts)
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "low", parts)
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", "m")).filter("u > v")
        pairs = materialise(small.distinct(), "edges", parts)
        state = pairs.agg(F.count("*").alias("n"), F.count_distinct("u").alias("d")).first()
        # Every node has one parent, and no parent has one: stars, that is whole components.
        if state.n == state.d and pairs.join(pairs.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return roots.union(roots.select("component", "component").distinct())
