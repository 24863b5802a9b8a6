"""Tokens and syntax tree of the expression language.

Columns stand in square brackets (``]]`` for a bracket) or as bare names, strings in single or double quotes (doubled to
escape), ``//`` starts a comment. ``OVER`` takes partitions, with or
without PARTITION BY, and an optional ORDER BY. ``not`` binds as tightly as a sign: ``not [a] = [b]`` is ``(not [a]) = [b]``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field


class ExpressionError(ValueError):
    """An expression that can't be read, or that asks for what the engine doesn't have."""


@dataclass(frozen=True)
class Token:
    kind: str  # name, column, number, string, operator, end
    text: str
    at: int


_PATTERNS = re.compile(
    r"""(?P<space>\s+|//[^\n]*)
    |(?P<column>\[(?:[^\]]|\]\])*\])
    |(?P<string>'(?:[^']|'')*'|"(?:[^"]|"")*")
    |(?P<number>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)
    |(?P<name>[A-Za-z_][A-Za-z0-9_]*)
    |(?P<operator><>|!=|<=|>=|~=|[-+*/%&=<>(),])""",
    re.VERBOSE,
)


def tokenize(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _PATTERNS.match(text, at)
        if not m:
            raise ExpressionError(f"unexpected character {text[at]!r} at {at}")
        kind, value = m.lastgroup, m[0]
        if kind == "column":
            value = value[1:-1].replace("]]", "]")
        elif kind == "string":
            value = value[1:-1].replace(value[0] * 2, value[0])
        if kind != "space":
            out.append(Token(kind, value, at))
        at = m.end()
    return [*out, Token("end", "", at)]


@dataclass(frozen=True)
class Node:
    pass


@dataclass(frozen=True)
class Column(Node):
    name: str


@dataclass(frozen=True)
class Literal(Node):
    value: object


@dataclass(frozen=True)
class Unary(Node):
    operator: str
    operand: Node


@dataclass(frozen=True)
class Binary(Node):
    operator: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...]


@dataclass(frozen=True)
class Case(Node):
    branches: tuple[tuple[Node, Node], ...]
    otherwise: Node


@dataclass(frozen=True)
class Cast(Node):
    operand: Node
    type: str


@dataclass(frozen=True)
class Order:
    by: Node
    descending: bool = False
    nulls_first: bool = False


@dataclass(frozen=True)
class Window(Node):
    call: Call
    partitions: tuple[Node, ...] = ()
    order: tuple[Order, ...] = field(default=())


#: Names of cast targets (fixed values); those of the first table are functions too.
CAST_FUNCTIONS = {
    "boolean": "bool", "integer": "int32", "longinteger": "int64", "single": "float32", "singlereal": "float32", "real": "float64",
    "decimal": "decimal", "currency": "decimal", "string": "string", "date": "date", "datetime": "timestamp", "time": "time", "timespan": "duration",
}
CAST_TYPES = CAST_FUNCTIONS | {"bigint": "int64", "double": "float64", "varchar": "string", "timestamp": "timestamp"}
_POWER = {"or": 10, "and": 20, "=": 30, "!=": 30, "<>": 30, "<": 30, "<=": 30, ">": 30, ">=": 30, "~=": 30, "+": 40, "-": 40, "&": 40, "*": 50, "/": 50, "%": 50}
_UNARY = 60
#: Words that never name a column without brackets.
_RESERVED = {"and", "or", "when", "then", "else", "end", "as", "over"}


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at = tokenize(text), 0

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def word(self) -> str:
        return self.now.text.lower() if self.now.kind in ("name", "operator") else ""

    def take(self, text: str | None = None) -> Token:
        token = self.now
        if text is not None and self.word() != text:
            raise ExpressionError(f"expected {text!r} at {token.at}, found {token.text!r}")
        self.at += 1
        return token

    def accept(self, text: str) -> bool:
        if self.word() == text:
            self.at += 1
            return True
        return False

    def expression(self, least: int = 0) -> Node:
        left = self.prefix()
        while (power := _POWER.get(self.word(), 0)) > least:
            operator = self.take().text.lower()
            left = Binary({"<>": "!="}.get(operator, operator), left, self.expression(power))
        return left

    def prefix(self) -> Node:
        token = self.take()
        word = token.text.lower()
        if token.kind == "number":
            return Literal(float(token.text) if re.search(r"[.eE]", token.text) else int(token.text))
        if token.kind == "string":
            return Literal(token.text)
        if token.kind == "column":
            return Column(token.text)
        if token.kind == "operator":
            if word in "+-" and word:
                return Unary(word, self.expression(_UNARY))
            if word == "(":
                inner = self.expression()
                self.take(")")
                return inner
        if token.kind == "name":
            if word in ("null", "true", "false"):
                return Literal({"null": None, "true": True, "false": False}[word])
            if word == "not":
                return Unary("not", self.expression(_UNARY))
            if word == "case":
                return self.case()
            if self.word() == "(":
                return self.call(token.text)
            if word not in _RESERVED:
                return Column(token.text)
        raise ExpressionError(f"unexpected {token.text or 'end'!r} at {token.at}")

    def case(self) -> Node:
        branches = []
        while self.accept("when"):
            condition = self.expression()
            self.take("then")
            branches.append((condition, self.expression()))
        otherwise = self.expression() if self.accept("else") else Literal(None)
        self.take("end")
        if not branches:
            raise ExpressionError("CASE without WHEN")
        return Case(tuple(branches), otherwise)

    def call(self, name: str) -> Node:
        self.take("(")
        lower = name.lower()
        if lower == "cast":
            operand = self.expression()
            if not self.accept("as"):
                self.take(",")
            target = self.take().text.lower()
            self.take(")")
            if target not in CAST_TYPES:
                raise ExpressionError(f"unknown cast type {target!r}")
            return Cast(operand, CAST_TYPES[target])
        args = []
        while self.word() != ")":
            args.append(self.expression())
            if not self.accept(","):
                break
        self.take(")")
        if lower in CAST_FUNCTIONS and len(args) == 1:
            return Cast(args[0], CAST_FUNCTIONS[lower])
        if lower == "if":
            if len(args) != 3:
                raise ExpressionError("If takes three arguments")
            return Case(((args[0], args[1]),), args[2])
        call = Call(lower, tuple(args))
        return self.over(call) if self.accept("over") else call

    def over(self, call: Call) -> Node:
        self.take("(")
        partitions, order = [], []
        if self.accept("partition"):
            self.take("by")
            if self.word() in (")", "order"):
                raise ExpressionError(f"PARTITION BY names nothing at {self.now.at}")
        while self.word() not in (")", "order"):
            partitions.append(self.expression())
            if not self.accept(",") and self.word() not in (")", "order"):
                raise ExpressionError(f"expected ',' at {self.now.at}, found {self.now.text!r}")
        if self.accept("order"):
            self.take("by")
            while True:
                by, descending, first = self.expression(), False, False
                if self.word() in ("asc", "desc"):
                    descending = self.take().text.lower() == "desc"
                if self.accept("nulls"):
                    if self.word() not in ("first", "last"):
                        raise ExpressionError(f"NULLS takes FIRST or LAST, not {self.now.text!r}")
                    first = self.take().text.lower() == "first"
                order.append(Order(by, descending, first))
                if not self.accept(","):
                    break
        self.take(")")
        return Window(call, tuple(partitions), tuple(order))


def parse(text: str) -> Node:
    parser = _Parser(text)
    node = parser.expression()
    if parser.now.kind != "end":
        raise ExpressionError(f"unexpected {parser.now.text!r} at {parser.now.at}")
    return node


def columns_of(node) -> set[str]:
    """Names of all columns that a tree reads."""
    if isinstance(node, Column):
        return {node.name}
    if isinstance(node, (Node, Order)):
        return set().union(*(columns_of(v) for v in vars(node).values()))
    if isinstance(node, tuple):
        return set().union(*map(columns_of, node))
    return set()
