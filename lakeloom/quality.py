"""Data quality rules, all counted in one aggregation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .types import spark_type


class AssertionFailed(ValueError):
    def __init__(self, failures: list[dict]):
        super().__init__(f"data assertions failed: {failures}")
        self.failures = failures


def _condition(rule: Mapping):
    """Condition under which a row breaks a row rule."""
    kind = rule["kind"]
    if kind == "not_null":
        out = F.lit(False)
        for c in rule["columns"]:
            out = out | F.col(f"`{c}`").isNull()
        return out
    column = F.col(f"`{rule['column']}`")
    if kind == "accepted_values":
        return column.isNotNull() & ~column.cast("string").isin([str(v) for v in rule["values"]])
    inclusive = rule.get("inclusive", True)
    if any(isinstance(rule.get(k), str) for k in ("min", "max")):
        column = column.cast("string")
    out = F.lit(False)
    if rule.get("min") is not None:
        out = out | (column < rule["min"] if inclusive else column <= rule["min"])
    if rule.get("max") is not None:
        out = out | (column > rule["max"] if inclusive else column >= rule["max"])
    return F.coalesce(out, F.lit(False))


ROW_RULES = ("not_null", "accepted_values", "range")


def evaluate(df: DataFrame, rules: Sequence[Mapping]) -> DataFrame:
    """(rule_id, kind, failed) for every rule. Row rules and row_count share one pass; each unique rule is a group count, with nulls equal."""
    spark, rows = df.sparkSession, []
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, rule in enumerate(rules):
        if rule["kind"] in ROW_RULES:
            aggs.append(F.count_if(_condition(rule)).alias(f"r{i}"))
    parts = None
    counted = df.agg(*aggs)
    for i, rule in enumerate(rules):
        kind, failed = rule["kind"], None
        if kind == "required_columns":
            failed = F.lit(sum(c not in df.columns for c in rule["columns"])).cast("long")
        elif kind == "dtype":
            failed = F.lit(sum(c not in df.columns or df.schema[c].dataType != spark_type(t) for c, t in rule["types"].items())).cast("long")
        elif kind in ROW_RULES:
            failed = F.col(f"r{i}")
        elif kind == "row_count":
            low, high = rule.get("min"), rule.get("max")
            failed = ((F.col("n") < low if low is not None else F.lit(False)) | (F.col("n") > high if high is not None else F.lit(False))).cast("long")
        if failed is not None:
            rows.append(F.struct(F.lit(rule.get("id", f"rule_{i}")).alias("rule_id"), F.lit(kind).alias("kind"), failed.alias("failed")))
        elif kind == "unique":
            groups = df.groupBy(*[f"`{c}`" for c in rule["columns"]]).agg(F.count(F.lit(1)).alias("c"))
            part = groups.agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("failed")).select(F.lit(rule.get("id", f"rule_{i}")).alias("rule_id"), F.lit(kind).alias("kind"), "failed")
            parts = part if parts is None else parts.unionByName(part)
        else:
            raise ValueError(f"unknown rule {kind!r}")
    out = counted.select(F.inline(F.array(*rows))) if rows else None
    return parts if out is None else out if parts is None else out.unionByName(parts)


def check(df: DataFrame, rules: Sequence[Mapping], samples: int = 20) -> None:
    """Raises with rule, kind, count and up to ``samples`` broken rows."""
    failures = []
    if not rules:
        return
    for r in evaluate(df, rules).filter("failed > 0").collect():
        rule = next(x for i, x in enumerate(rules) if x.get("id", f"rule_{i}") == r.rule_id)
        rows = [row.asDict() for row in df.filter(_condition(rule)).limit(samples).collect()] if r.kind in ROW_RULES else []
        failures.append({"rule_id": r.rule_id, "kind": r.kind, "failed": r.failed, "samples": rows})
    if failures:
        raise AssertionFailed(failures)
