"""Syntax trees to Spark columns."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar, windows
from ..functions.scalar import FunctionError, Value
from ..types import kind_of, spark_type
from . import parser as p
from .parser import ExpressionError

_KIND = {"bool": "bool", "int32": "int", "int64": "int", "float32": "float", "float64": "float", "decimal": "decimal", "string": "string", "date": "date", "timestamp": "timestamp", "time": "duration", "duration": "duration"}


class _WindowContext:
    """What window functions ask of the compiler: one partitioning, one order."""

    def __init__(self, compiler: Compiler, parts: list[Column], order: list[Column], plain_order: list[Column]):
        self.compiler, self.parts, self.has_order = compiler, parts, bool(order)
        self._order = order
        self._plain = plain_order

    def step(self, column: Column) -> Column:
        return self.compiler.step(column)

    def over(self, aggregate: Column, *more: Column) -> Column:
        """An aggregate over the rows of one partition, for which their order is nothing."""
        return self.compiler.group((*self.parts, *more), aggregate)

    def quantile(self, x: Column, p: float) -> Column:
        return self.compiler.group(tuple(self.parts), x, p)

    def position(self) -> Column:
        """A row's place in the active order."""
        order = self.compiler.active_order()
        return F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])

    def _sorted(self):
        return W.partitionBy(*self.parts).orderBy(*self._order, *self.compiler.active_order())

    def ordered(self, function: Column) -> Column:
        return function.over(self._sorted())

    def framed(self, function: Column, start: int | None, end: int | None) -> Column:
        return function.over(self._sorted().rowsBetween(W.unboundedPreceding if start is None else start, W.unboundedFollowing if end is None else end))

    def ranked(self, function: Column, order: Column, parts: list[Column]) -> Column:
        return function.over(W.partitionBy(*self.parts, *parts).orderBy(order))


class _Built:
    """Equal for columns that are built alike, types of literals included."""

    def __init__(self, column: Column):
        self.node = column._jc.node().normalized()

    def __hash__(self):
        return self.node.hashCode()

    def __eq__(self, other):
        return isinstance(other, _Built) and self.node.equals(other.node)


@dataclass(frozen=True)
class _Step:
    """A column below an expression; with ``parts``, an aggregate (or the ``share`` quantile of a column) by these, joined back."""

    name: str
    column: Column
    parts: tuple[Column, ...] | None = None
    share: float | None = None

    def needs(self) -> set[str]:
        text = " ".join(c._jc.toString() for c in (self.column, *(self.parts or ())))
        return set(re.findall(r"_lk_(?:\d+|row)\b", text)) - {self.name}


def _with_groups(df: DataFrame, steps: list[_Step]) -> DataFrame:
    """Adds aggregates by their partitions: one aggregation for all of one partitioning, with partial sums before the shuffle, and one join."""
    by_parts: dict[tuple[_Built, ...], list[_Step]] = {}
    for step in steps:
        by_parts.setdefault(tuple(_Built(p) for p in step.parts), []).append(step)
    for members in by_parts.values():
        keys = [f"_lk_key_{i}" for i in range(len(members[0].parts))]
        aggregates, shares = {}, {}
        for step in members:
            if step.share is None:
                aggregates[step.name] = step.column.alias(step.name)
            else:
                shares.setdefault(_Built(step.column), []).append(step)
        picks = {}
        for i, asked in enumerate(shares.values()):  # all quantiles of one column come from one pass
            every = sorted({s.share for s in asked})
            aggregates[f"_lk_q{i}"] = F.percentile(asked[0].column, F.array(*[F.lit(p) for p in every])).alias(f"_lk_q{i}")
            picks |= {s.name: F.get(F.col(f"_lk_q{i}"), F.lit(every.index(s.share))) for s in asked}
        grouped = df.groupBy(*[p.alias(k) for p, k in zip(members[0].parts, keys, strict=True)]).agg(*aggregates.values())
        grouped = grouped.withColumns(picks).drop(*[n for n in aggregates if n.startswith("_lk_q")]) if picks else grouped
        test = None
        for part, key in zip(members[0].parts, keys, strict=True):
            same = part.eqNullSafe(F.col(key))
            test = same if test is None else test & same
        df = df.join(grouped, test, "left").drop(*keys) if keys else df.join(F.broadcast(grouped))  # without partitions: one row
    return df


def _with_steps(df: DataFrame, steps: Sequence[_Step]) -> DataFrame:
    """Adds steps layer by layer: each reads the input and steps of earlier layers."""
    todo, names = list(steps), {s.name for s in steps}
    while todo:
        names = {s.name for s in todo}
        layer = [s for s in todo if not s.needs() & names]
        if not layer:
            raise ExpressionError("steps depend on each other")
        plain = {s.name: s.column for s in layer if s.parts is None}
        df = df.withColumns(plain) if plain else df
        df = _with_groups(df, [s for s in layer if s.parts is not None])
        todo = [s for s in todo if s not in layer]
    return df


class Compiler:
    """Compiles expressions over one frame. ``order``: columns that give its rows a total order; by default Spark's row ids."""

    def __init__(self, df: DataFrame, order: Sequence[str] = ()):
        self.df, self.order = df, list(order)
        self.kinds = {f.name: kind_of(f.dataType) for f in df.schema.fields}
        self.steps: dict[tuple, _Step] = {}

    def _add(self, key: tuple, column: Column, parts=None, share=None, name: str | None = None) -> Column:
        if key not in self.steps:
            self.steps[key] = _Step(name or f"_lk_{len(self.steps)}", column, parts, share)
        return F.col(self.steps[key].name)

    def step(self, column: Column) -> Column:
        """Adds a column below the expression, once for all that are built alike, and returns a reference to it."""
        return self._add((_Built(column),), column)

    def group(self, parts: tuple[Column, ...], column: Column, share: float | None = None) -> Column:
        """Adds an aggregate by ``parts``, or the ``share`` quantile of ``column`` there, and returns a reference to it."""
        return self._add((_Built(column), share, *map(_Built, parts)), column, parts, share)

    def active_order(self) -> list[Column]:
        if not self.order:
            return [self._add(("row",), F.monotonically_increasing_id(), name="_lk_row")]
        return [F.col(f"`{c}`") for c in self.order]

    def compile(self, node: p.Node) -> Value:
        try:
            return getattr(self, "_" + type(node).__name__.lower())(node)
        except FunctionError as error:
            raise ExpressionError(str(error)) from error

    def _column(self, node):
        if node.name not in self.kinds:
            raise ExpressionError(f"unknown column [{node.name}]")
        return Value(F.col(f"`{node.name}`"), self.kinds[node.name])

    def _literal(self, node):
        v = node.value
        kind = "null" if v is None else "bool" if isinstance(v, bool) else "int" if isinstance(v, int) else "float" if isinstance(v, float) else "string"
        return Value(F.lit(v).cast("long") if kind == "int" else F.lit(v), kind, v)

    def _unary(self, node):
        value = self.compile(node.operand)
        if node.operator == "not":
            if value.kind not in ("bool", "null"):
                raise ExpressionError("not takes a truth value; it binds before comparisons, so put those in parentheses")
            return Value(~value.col, "bool")
        if value.kind not in ("int", "float", "decimal", "null"):
            raise ExpressionError(f"unary {node.operator} takes a number")
        column = value.col.cast("long" if value.kind == "int" else "double")
        negative = node.operator == "-"
        literal = -value.literal if negative and value.literal is not None else value.literal
        return Value(-column if negative else column, "int" if value.kind == "int" else "float", literal)

    def _binary(self, node):
        a, b, op = self.compile(node.left), self.compile(node.right), node.operator
        if isinstance(a.kind, tuple) or isinstance(b.kind, tuple):
            return self._lists(op, a, b)
        return binary(op, a, b)

    def _lists(self, op, a, b):
        """Element by element; a scalar goes with every element."""
        inner = [v.kind[1] if isinstance(v.kind, tuple) else v.kind for v in (a, b)]
        probe = binary(op, Value(a.col, inner[0]), Value(b.col, inner[1]))

        def element(x, y):
            return binary(op, Value(x, inner[0]), Value(y, inner[1])).col

        if isinstance(a.kind, tuple) and isinstance(b.kind, tuple):
            same = F.size(a.col) == F.size(b.col)
            both = F.when(a.col.isNotNull() & b.col.isNotNull(), scalar.raise_unless(same, F.zip_with(a.col, b.col, element), "lists differ in length"))
            return Value(both, ("list", probe.kind))
        lists, one = (a, b) if isinstance(a.kind, tuple) else (b, a)
        return Value(F.transform(lists.col, lambda x: element(x, one.col) if lists is a else element(one.col, x)), ("list", probe.kind))

    def _case(self, node):
        values = [self.compile(v) for _, v in node.branches] + [self.compile(node.otherwise)]
        kinds = {v.kind for v in values if v.kind != "null"}
        if kinds <= {"int", "float", "decimal"} and len(kinds) > 1:
            values, kinds = [Value(v.col.cast("double"), "float") for v in values], {"float"}
        if kinds == {"date", "timestamp"}:
            values, kinds = [Value(v.col.cast("timestamp_ntz"), "timestamp") for v in values], {"timestamp"}
        if len(kinds) > 1:
            raise ExpressionError(f"CASE branches differ in type: {sorted(map(str, kinds))}")
        out = None
        for (condition, _), value in zip(node.branches, values, strict=False):
            test = self.compile(condition).col
            out = F.when(test, value.col) if out is None else out.when(test, value.col)
        return Value(out.otherwise(values[-1].col), kinds.pop() if kinds else "null")

    def _cast(self, node):
        value = self.compile(node.operand)
        target = node.type
        if target == "time":
            return Value(scalar.parsetime(Value(value.col.cast("string"), "string")).col, "duration")
        column = value.col
        if value.kind == "float" and target in ("int32", "int64"):
            column = F.when(~F.isnan(column), column)
        return Value(column.try_cast(spark_type(target)), _KIND[target])

    def _call(self, node):
        name = node.name
        if name in scalar.UNSUPPORTED:
            raise ExpressionError(f"function {name} is not supported")
        if name in ("rand", "randbetween"):
            args = [self.compile(a) for a in node.args]
            order = self.active_order()
            return (scalar.rand if name == "rand" else scalar.randbetween)(*args, F.xxhash64(*order))
        if name in scalar.SCALARS and not (name in windows.NAMES and name in ("mod",)):
            least, most, function = scalar.SCALARS[name]
            if not least <= len(node.args) <= most:
                raise ExpressionError(f"{name} takes {least} to {most} arguments")
            return function(*[self.compile(a) for a in node.args])
        if name in windows.NAMES:
            return self._window(p.Window(node))
        raise ExpressionError(f"unknown function {name}")

    def _window(self, node):
        args = [self.compile(a) for a in node.call.args]
        parts = [self.compile(x).col for x in node.partitions]
        order = []
        for o in node.order:
            column = self.compile(o.by).col
            order.append((column.desc_nulls_first() if o.nulls_first else column.desc_nulls_last()) if o.descending else (column.asc_nulls_first() if o.nulls_first else column.asc_nulls_last()))
        value = windows.evaluate(_WindowContext(self, parts, order, []), node.call.name, args)
        if value is None:
            raise ExpressionError(f"{node.call.name} is not a window function")
        return Value(self.step(value.col), value.kind)


def binary(op: str, a: Value, b: Value) -> Value:
    if op in ("and", "or"):
        return Value(a.col & b.col if op == "and" else a.col | b.col, "bool")
    if op == "&":
        if {a.kind, b.kind} - {"string", "null"}:
            raise ExpressionError("& joins text only")
        return Value(F.concat(a.col, b.col), "string")
    if op == "~=":
        return Value(F.contains(a.col, b.col), "bool")
    numbers = {"int", "float", "decimal", "null"}
    if op in ("+", "-", "*", "/", "%"):
        if {a.kind, b.kind} - numbers:
            raise ExpressionError(f"{op} takes numbers, not {a.kind} and {b.kind}")
        if op == "/":
            return Value(scalar.divide(a.col.cast("double"), b.col.cast("double")), "float")
        whole = {a.kind, b.kind} <= {"int", "null"}
        x, y = (v.col.cast("long" if whole else "double") for v in (a, b))
        if op == "%":
            return Value(x % y, "int") if whole else Value(scalar.modulo(x, y), "float")
        return Value(x + y if op == "+" else x - y if op == "-" else x * y, "int" if whole else "float")
    x, y = a.col, b.col
    if {a.kind, b.kind} <= numbers and a.kind != b.kind:
        x, y = x.cast("double"), y.cast("double")
    return Value({"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], "bool")


def compile_expression(df: DataFrame, text: str, name: str, order: Sequence[str] = ()) -> DataFrame:
    """``df`` with column ``name`` computed by ``text``."""
    return add_expressions(df, {name: text}, order)


def layers(expressions: dict[str, p.Node]) -> list[list[str]]:
    """Names in layers: each reads only columns of the input and names of earlier layers; a cycle is an error."""
    needs = {name: {c for c in p.columns_of(node) if c in expressions and c != name} for name, node in expressions.items()}
    out, done = [], set()
    while len(done) < len(needs):
        layer = [n for n, need in needs.items() if n not in done and need <= done]
        if not layer:
            raise ExpressionError(f"expressions depend on each other: {sorted(set(needs) - done)}")
        out.append(layer)
        done.update(layer)
    return out


def add_expressions(df: DataFrame, expressions: dict[str, str], order: Sequence[str] = ()) -> DataFrame:
    """Adds named expressions, layer by layer; all of one layer read the same input, and a name may replace a column."""
    trees = {name: p.parse(text) for name, text in expressions.items()}
    for layer in layers(trees):
        compiler = Compiler(df, order)
        made = {name: compiler.compile(trees[name]).col for name in layer}
        df = _with_steps(df, compiler.steps.values()).withColumns(made).drop(*[s.name for s in compiler.steps.values()])
    return df


def condition(df: DataFrame, text: str, order: Sequence[str] = ()) -> DataFrame:
    """Rows of ``df`` for which the expression is true."""
    compiler = Compiler(df, order)
    test = compiler.compile(p.parse(text)).col
    names = df.columns
    return _with_steps(df, compiler.steps.values()).filter(test).select(*[f"`{n}`" for n in names])
