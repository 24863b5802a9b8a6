"""Named expressions from files: CSV with columns name and expression, or YAML as a mapping, a list of {name, expression}, or layers of either."""

from __future__ import annotations

import csv
import io
from collections.abc import Mapping
from pathlib import Path

from .parser import ExpressionError, parse


def _entries(value):
    if isinstance(value, Mapping):
        if set(value) >= {"name", "expression"}:
            yield value["name"], value["expression"]
        elif "layers" in value:
            yield from _entries(value["layers"])
        elif "expressions" in value:
            yield from _entries(value["expressions"])
        else:
            yield from value.items()
    elif isinstance(value, list):
        for item in value:
            yield from _entries(item)
    else:
        raise ExpressionError(f"not an expression entry: {value!r}")


def load(path: str, text: str | None = None) -> dict[str, str]:
    """Expressions by name, in order; each must parse, and a name comes once."""
    text = Path(path).read_text() if text is None else text
    if path.endswith(".csv"):
        pairs = [(r["name"], r["expression"]) for r in csv.DictReader(io.StringIO(text))]
    else:
        import yaml

        pairs = list(_entries(yaml.safe_load(text)))
    out: dict[str, str] = {}
    for name, expression in pairs:
        if name in out:
            raise ExpressionError(f"{name} is defined twice")
        parse(str(expression))
        out[name] = str(expression)
    return out
