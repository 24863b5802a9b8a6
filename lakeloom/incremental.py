"""What changed since the last run."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from .expr.parser import columns_of, parse
from .sinks import fingerprint


@dataclass
class Delta:
    mode: str  # initial, delta, unchanged or full
    process: list[str] = field(default_factory=list)
    remove: list[str] = field(default_factory=list)


def contract(expressions: Mapping[str, str], **options) -> str:
    """Hash of everything that decides a calculation's result."""
    return fingerprint(dict(expressions), options)


def plan(parts: Mapping[str, str], receipt: Mapping | None, contract_hash: str) -> Delta:
    """Segments (path: content hash) to process and remove, given the last receipt {contract, parts}.

    Without a receipt everything is initial; under another contract everything runs again.
    """
    if receipt is None:
        return Delta("initial", sorted(parts))
    old = receipt["parts"]
    gone = sorted(set(old) - set(parts))
    if receipt["contract"] != contract_hash:
        return Delta("full", sorted(parts), gone)
    changed = sorted(p for p, h in parts.items() if old.get(p) != h)
    return Delta("delta" if changed or gone else "unchanged", changed, gone)


def runnable(expressions: Mapping[str, str], columns) -> tuple[dict[str, str], dict[str, list[str]]]:
    """Expressions whose inputs exist, and those skipped (also through other expressions) with what they miss."""
    have, left, skipped = set(columns), dict(expressions), {}
    trees = {name: columns_of(parse(text)) for name, text in expressions.items()}
    while True:
        available = have | set(left)
        bad = {n: sorted(trees[n] - available | ({n} & trees[n] - have)) for n in left}
        bad = {n: m for n, m in bad.items() if m}
        if not bad:
            return left, skipped
        for n, m in bad.items():
            skipped[n] = m
            del left[n]
