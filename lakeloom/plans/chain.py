"""Chains of definitions, and their schedules."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from .. import sinks
from . import definition


@dataclass
class Result:
    status: dict[str, str] = field(default_factory=dict)  # ran, reused, failed or blocked
    receipts: dict[str, dict] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)


def order(needs: Mapping[str, Sequence[str]]) -> list[str]:
    """Names so that each comes after what it needs; ties by name."""
    out: list[str] = []
    left = {n: set(d) for n, d in needs.items()}
    if unknown := {d for ds in left.values() for d in ds} - set(left):
        raise ValueError(f"unknown assets: {sorted(unknown)}")
    while left:
        ready = sorted(n for n, d in left.items() if not d - set(out))
        if not ready:
            raise ValueError(f"assets need each other: {sorted(left)}")
        out.append(ready[0])
        del left[ready[0]]
    return out


def run(spark: SparkSession, assets: Mapping[str, Mapping], fingerprints: dict[str, str] | None = None) -> Result:
    """Runs assets {name: definition} in order. One whose definition and inputs are unchanged is reused; what needs a failed one is blocked."""
    docs = {n: definition.load(d) for n, d in assets.items()}
    needs = {n: [s["asset"] for s in d["sources"].values() if "asset" in s] for n, d in docs.items()}
    outputs = {n: d["output"]["path"] for n, d in docs.items()}
    result, known = Result(), fingerprints if fingerprints is not None else {}
    for name in order(needs):
        if any(result.status[n] in ("failed", "blocked") for n in needs[name]):
            result.status[name] = "blocked"
            continue
        inputs = {n: (sinks.read_manifest(spark, outputs[n]) or {}).get("generation") for n in needs[name]}
        mark = sinks.fingerprint(docs[name], inputs)
        if known.get(name) == mark and sinks.read_manifest(spark, outputs[name]):
            result.status[name] = "reused"
            continue
        try:
            result.receipts[name] = definition.run(spark, docs[name], outputs)
            result.status[name], known[name] = "ran", mark
        except Exception as error:  # the chain reports it and goes on with what doesn't need this asset
            result.status[name], result.errors[name] = "failed", str(error)
    return result


def _field(text: str, low: int, high: int) -> set[int]:
    out: set[int] = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        a, _, b = span.partition("-")
        first, last = (low, high) if a == "*" else (int(a), int(b) if b else (high if step else int(a)))
        if not low <= first <= last <= high:
            raise ValueError(f"bad cron field {text!r}")
        out.update(range(first, last + 1, int(step or 1)))
    return out


@dataclass(frozen=True)
class Cron:
    """Minute, hour, day of month, month and day of week (0 is Sunday) of a schedule."""

    text: str

    def matches(self, at: dt.datetime) -> bool:
        minute, hour, day, month, week = self.text.split()
        day_ok, week_ok = at.day in _field(day, 1, 31), (at.weekday() + 1) % 7 in {d % 7 for d in _field(week, 0, 7)}
        both = day_ok and week_ok if "*" in (day, week) else day_ok or week_ok
        return at.minute in _field(minute, 0, 59) and at.hour in _field(hour, 0, 23) and at.month in _field(month, 1, 12) and both

    def due(self, since: dt.datetime, now: dt.datetime) -> list[dt.datetime]:
        """Occurrences after ``since`` up to ``now``."""
        at = since.replace(second=0, microsecond=0) + dt.timedelta(minutes=1)
        out = []
        while at <= now:
            if self.matches(at):
                out.append(at)
            at += dt.timedelta(minutes=1)
        return out


def tick(schedules: Mapping[str, Mapping], state: dict[str, dt.datetime], now: dt.datetime) -> list[tuple[str, dt.datetime]]:
    """Schedules {name: {cron, misfire}} to start now. Missed occurrences are skipped, or caught up once with the latest; ``state`` is moved on."""
    out = []
    for name, schedule in schedules.items():
        missed = Cron(schedule["cron"]).due(state.get(name, now - dt.timedelta(minutes=1)), now)
        if missed and (schedule.get("misfire", "skip") == "catch_up_once" or missed[-1] == now.replace(second=0, microsecond=0)):
            out.append((name, missed[-1]))
        state[name] = now
    return out
