"""Date windows, SQL templates and the tasks of an extraction."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

DAY = dt.timedelta(days=1)


def moment(value, now: dt.datetime) -> dt.datetime:
    """An absolute time, or one relative to ``now`` such as ``-3d``, ``+2h`` or ``today``."""
    if isinstance(value, dt.datetime):
        return value
    text = str(value).strip().lower()
    if text in ("now", "today"):
        return now if text == "now" else now.replace(hour=0, minute=0, second=0, microsecond=0)
    if m := re.fullmatch(r"([+-]\d+)([dhm])", text):
        step = {"d": DAY, "h": dt.timedelta(hours=1), "m": dt.timedelta(minutes=1)}[m[2]]
        base = now.replace(hour=0, minute=0, second=0, microsecond=0) if m[2] == "d" else now
        return base + int(m[1]) * step
    return dt.datetime.fromisoformat(text)


def expand(start, end, step: dt.timedelta, now: dt.datetime, anchor: dt.datetime = dt.datetime(1970, 1, 1)) -> list[tuple[dt.datetime, dt.datetime]]:
    """Half-open windows over [start, end): whole days from the start, shorter steps on a grid from ``anchor``."""
    start, end = moment(start, now), moment(end, now)
    if step <= dt.timedelta(0) or (step > DAY and step % DAY):
        raise ValueError("a step is a part of a day or whole days")
    out, at = [], start
    while at < end:
        nxt = at + step if step % DAY == dt.timedelta(0) else anchor + ((at - anchor) // step + 1) * step
        out.append((at, min(nxt, end)))
        at = nxt
    return out


def template_sql(table: str, columns: Sequence[str], date_column: str, filters: Sequence[str] = ()) -> str:
    """Select list, AND filters, and the half-open window as named parameters."""
    where = [f"({f})" for f in filters] + [f"{date_column} >= :date_from", f"{date_column} < :date_to"]
    return f"SELECT {', '.join(columns)} FROM {table} WHERE {' AND '.join(where)}"


def prefix_filter(column: str, value: str | Sequence[str]) -> str:
    """``substring(column, 1, n) = value`` as LIKE, which sources and Parquet can push down."""
    values = [value] if isinstance(value, str) else list(value)

    def like(v):
        text = v.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("'", "''")
        return f"{column} LIKE '{text}%'"

    return " OR ".join(map(like, values))


def tasks(windows: Sequence[tuple], sub_jobs: Sequence[Mapping] = ({},)) -> list[dict]:
    """One task for each window and sub-job filter set."""
    return [{"date_from": a, "date_to": b, "filters": dict(s)} for a, b in windows for s in sub_jobs]


def extract(spark: SparkSession, sql: str, windows: Sequence[tuple], adapter: str = "spark_sql", sub_jobs: Sequence[Mapping] = ({},), parameters: Mapping | None = None) -> DataFrame:
    """Every window and sub-job of a template through a source adapter, as one lazy union.

    Adapters get the window and a sub-job's values as parameters ``date_from``, ``date_to`` and by name.
    """
    if adapter not in ADAPTERS:
        raise ValueError(f"unknown adapter {adapter!r}")
    out = None
    for task in tasks(windows, sub_jobs):
        given = dict(parameters or {}) | task["filters"] | {k: task[k].isoformat(sep=" ") for k in ("date_from", "date_to")}
        part = ADAPTERS[adapter](spark, sql, given)
        out = part if out is None else out.unionAll(part)
    if out is None:
        raise ValueError("no windows to extract")
    return out


def read_windows(spark: SparkSession, source: Mapping, now: dt.datetime | None = None) -> DataFrame:
    """A windowed source of a definition: ``sql``, or ``table``, ``columns``, ``date_column`` and ``filters``; ``start``, ``end``, ``step`` (such as 1d, 6h, 15m), ``adapter``, ``sub_jobs``, ``parameters``."""
    sql = source.get("sql") or template_sql(source["table"], source["columns"], source["date_column"], source.get("filters", ()))
    m = re.fullmatch(r"(\d+)([dhm])", str(source.get("step", "1d")))
    if not m:
        raise ValueError(f"a step is a number of d, h or m, not {source['step']!r}")
    step = int(m[1]) * {"d": DAY, "h": dt.timedelta(hours=1), "m": dt.timedelta(minutes=1)}[m[2]]
    spans = expand(source["start"], source["end"], step, now or dt.datetime.now(dt.UTC).replace(tzinfo=None))
    return extract(spark, sql, spans, source.get("adapter", "spark_sql"), source.get("sub_jobs") or ({},), source.get("parameters"))


ADAPTERS: dict[str, object] = {}


def adapter(name: str):
    """Registers a source adapter: a function (spark, sql, parameters) -> DataFrame."""

    def add(function):
        ADAPTERS[name] = function
        return function

    return add


@adapter("spark_sql")
def _spark_sql(spark, sql, parameters):
    return spark.sql(sql, args=dict(parameters))


@adapter("jdbc")
def _jdbc(spark, sql, parameters):
    """Parameters that the template names are written into it as text literals; the others are options of the connection."""
    named = {k: v for k, v in parameters.items() if f":{k}" in sql}
    for name, value in named.items():
        sql = re.sub(rf":{name}\b", lambda _, v=value: "'" + str(v).replace("'", "''") + "'", sql)
    return spark.read.format("jdbc").options(query=sql, **{k: v for k, v in parameters.items() if k not in named}).load()
