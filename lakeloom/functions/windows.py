"""Partition window functions.

A function may need columns of its own first (a mean before the deviations from it): it asks the
compiler for them with ``step``, and the compiler adds them to the frame one layer below. Statistics for which the order of
rows is nothing (``over``, ``quantile``) become one aggregation by the partition, joined back; the others are windows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .scalar import FunctionError, Value

NUMERIC: dict[str, object] = {}
ROLLING = {"rollingavg": F.avg, "rollingmean": F.avg, "rollingsum": F.sum, "rollingmin": F.min, "rollingmax": F.max}


def _fence(c, x, side: int, width: float):
    q1, q3 = c.step(c.quantile(x, 0.25)), c.step(c.quantile(x, 0.75))
    return q1 - width * (q3 - q1) if side < 0 else q3 + width * (q3 - q1)


def _inlier(c, x):
    low, high = c.step(_fence(c, x, -1, 1.5)), c.step(_fence(c, x, 1, 1.5))
    return (x >= low) & (x <= high)


def _error(c, x, by):
    return c.over(F.avg(x)) + by * c.over(F.stddev_samp(x)) / F.sqrt(c.over(F.count(x)))


def _outliers(c, x, share):
    out = c.over(F.sum(F.when(_inlier(c, x), 0.0).when(x.isNotNull(), 1.0)))
    return F.try_divide(out, c.over(F.count(x))) if share else out


def _mean_deviation(c, x):
    return c.over(F.avg(F.abs(x - c.step(c.over(F.avg(x))))))


def _median_deviation(c, x):
    return c.quantile(c.step(F.abs(x - c.step(c.quantile(x, 0.5)))), 0.5)


def _trimmed(c, x, percent):
    low = c.step(c.quantile(x, percent / 200))
    high = c.step(c.quantile(x, 1 - percent / 200))
    return c.over(F.avg(F.when((x >= low) & (x <= high), x)))


NUMERIC |= {
    "sum": lambda c, x: c.over(F.sum(x)),
    "product": lambda c, x: c.over(F.product(x)),
    "avg": lambda c, x: c.over(F.avg(x)),
    "average": lambda c, x: c.over(F.avg(x)),
    "mean": lambda c, x: c.over(F.avg(x)),
    "min": lambda c, x: c.over(F.min(x)),
    "max": lambda c, x: c.over(F.max(x)),
    "median": lambda c, x: c.quantile(x, 0.5),
    "p10": lambda c, x: c.quantile(x, 0.1),
    "p90": lambda c, x: c.quantile(x, 0.9),
    "q1": lambda c, x: c.quantile(x, 0.25),
    "q3": lambda c, x: c.quantile(x, 0.75),
    "iqr": lambda c, x: c.quantile(x, 0.75) - c.quantile(x, 0.25),
    "var": lambda c, x: c.over(F.var_samp(x)),
    "variance": lambda c, x: c.over(F.var_samp(x)),
    "stddev": lambda c, x: c.over(F.stddev_samp(x)),
    "range": lambda c, x: c.over(F.max(x)) - c.over(F.min(x)),
    "geometricmean": lambda c, x: F.when(c.over(F.min(x)) > 0, F.exp(c.over(F.avg(F.ln(x))))),
    "stderr": lambda c, x: c.over(F.stddev_samp(x)) / F.sqrt(c.over(F.count(x))),
    "l95": lambda c, x: _error(c, x, -1.96),
    "u95": lambda c, x: _error(c, x, 1.96),
    "lif": lambda c, x: _fence(c, x, -1, 1.5),
    "uif": lambda c, x: _fence(c, x, 1, 1.5),
    "lof": lambda c, x: _fence(c, x, -1, 3.0),
    "uof": lambda c, x: _fence(c, x, 1, 3.0),
    "lav": lambda c, x: c.over(F.min(F.when(_inlier(c, x), x))),
    "uav": lambda c, x: c.over(F.max(F.when(_inlier(c, x), x))),
    "outliers": lambda c, x: _outliers(c, x, False),
    "pctoutliers": lambda c, x: _outliers(c, x, True),
    "meandeviation": _mean_deviation,
    "medianabsolutedeviation": _median_deviation,
}


def _literal(value: Value, what: str):
    if value.literal is None:
        raise FunctionError(f"{what} must be a literal")
    return value.literal


def _nth(c, x, n, descending):
    ordered = F.sort_array(F.filter(c.over(F.collect_list(x)), lambda v: v.isNotNull()), asc=not descending)
    return F.when(F.lit(n) >= 1, F.get(ordered, F.lit(n - 1)))


def evaluate(c, name: str, args: list[Value]) -> Value | None:
    """The window function ``name``, or None if there is none. ``c`` gives over, step, ordered, order columns."""
    if name in NUMERIC and len(args) == 1:
        return Value(NUMERIC[name](c, c.step(args[0].col.cast("double"))), "float")
    if name == "percentile":
        p = float(_literal(args[1], "a percentile"))
        return Value(c.quantile(args[0].col.cast("double"), p / 100) if 0 <= p <= 100 else F.lit(None).cast("double"), "float")
    if name == "trimmedmean":
        return Value(_trimmed(c, c.step(args[0].col.cast("double")), float(_literal(args[1], "the share"))), "float")
    if name in ("nthlargest", "nthsmallest"):
        return Value(_nth(c, args[0].col.cast("double"), int(_literal(args[1], "n")), name == "nthlargest"), "float")
    if name == "covariance":
        return Value(c.over(F.covar_samp(args[0].col.cast("double"), args[1].col.cast("double"))), "float")
    if name == "weightedaverage":
        x, w = (a.col.cast("double") for a in args[:2])
        both = x.isNotNull() & w.isNotNull()
        return Value(F.try_divide(c.over(F.sum(F.when(both, x * w))), c.over(F.sum(F.when(both, w)))), "float")
    if name in ("count", "countbig"):
        return Value(c.over(F.count(args[0].col) if args else F.count(F.lit(1))), "int")
    if name == "uniquecount":
        return Value(F.size(c.over(F.collect_set(args[0].col.cast("string")))).cast("long"), "int")
    if name == "mostcommon":
        x = args[0].col
        times = c.step(F.when(x.isNotNull(), F.struct((-c.over(F.count(x), x)).alias("n"), c.position().alias("at"))))
        return Value(c.over(F.min_by(x, times)), args[0].kind)
    if name == "uniqueconcatenate":
        x = args[0].col.cast("string")
        seen = c.over(F.collect_list(F.when(x.isNotNull(), F.struct(c.position().alias("at"), x.alias("x")))))
        return Value(F.array_join(F.array_distinct(F.transform(F.sort_array(seen), lambda v: v["x"])), ","), "string")
    if name in ("valueformax", "lastvalueformax", "valueformin", "lastvalueformin"):
        value, key = args[0].col, args[1].col
        rank = F.when(key.isNotNull(), F.struct(key.alias("k"), c.position().alias("at")))
        return Value(c.over((F.max_by if name.endswith("max") else F.min_by)(value, rank)), args[0].kind)
    if name in ("denserank", "rankreal"):
        return _rank(c, name, args)
    if name == "rownumber":
        if not c.has_order:
            raise FunctionError("RowNumber needs ORDER BY")
        return Value(c.ordered(F.row_number()).cast("long"), "int")
    if name in ("lag", "lead"):
        n = int(_literal(args[1], "the distance")) if len(args) > 1 else 1
        return Value(c.ordered((F.lag if name == "lag" else F.lead)(args[0].col, n)), args[0].kind)
    if name in ("first", "last"):
        pick = F.min_by if name == "first" else F.max_by
        return Value(c.over(pick(args[0].col, c.position())), args[0].kind)
    if name == "firstvalidafter":
        return Value(c.framed(F.first(args[0].col, ignorenulls=True), 0, None), args[0].kind)
    if name == "lastvalidbefore":
        return Value(c.framed(F.last(args[0].col, ignorenulls=True), None, 0), args[0].kind)
    if name in ROLLING:
        if not c.has_order:
            raise FunctionError(f"{name} needs ORDER BY")
        size = int(_literal(args[1], "the size"))
        least = int(_literal(args[2], "the least number")) if len(args) > 2 else 1
        x = args[0].col.cast("double")
        return Value(F.when(c.framed(F.count(x), 1 - size, 0) >= least, c.framed(ROLLING[name](x), 1 - size, 0)), "float")
    return None


def _rank(c, name, args):
    """Literals among the further arguments are options, all others partitions."""
    options = [str(a.literal).lower() for a in args[1:] if a.literal is not None]
    parts = [a.col for a in args[1:] if a.literal is None]
    if wrong := [o for o in options if o not in ("asc", "desc", "ties.method=average", "average")]:
        raise FunctionError(f"unknown rank option {wrong[0]!r}")
    x = args[0].col
    order = x.desc_nulls_last() if "desc" in options else x.asc_nulls_last()
    if name == "denserank":
        return Value(F.when(x.isNotNull(), c.ranked(F.dense_rank(), order, parts).cast("double")), "float")
    ties = c.over(F.count(x), x, *parts)
    return Value(F.when(x.isNotNull(), c.ranked(F.rank(), order, parts) + (ties - 1) / 2.0), "float")


NAMES = {*NUMERIC, *ROLLING, "percentile", "trimmedmean", "nthlargest", "nthsmallest", "covariance", "weightedaverage", "count", "countbig", "uniquecount", "mostcommon", "uniqueconcatenate", "valueformax", "lastvalueformax", "valueformin", "lastvalueformin", "denserank", "rankreal", "rownumber", "lag", "lead", "first", "last", "firstvalidafter", "lastvalidbefore"}
