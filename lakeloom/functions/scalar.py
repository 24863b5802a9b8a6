"""Scalar functions. Each takes the compiled arguments (column and kind) and returns the same; null in, null out."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
NAN = float("nan")


class Value(NamedTuple):
    col: Column
    kind: object
    literal: object = None


class FunctionError(ValueError):
    pass


#: Functions of the language that no engine of this dialect evaluates (fixed values).
UNSUPPORTED = {
    "autobinnumeric", "binbyevendistance", "binbyevendistribution", "binbyevenintervals", "binbyspecificlimits", "chidist", "chiinv", "fdist", "finv",
    "normdist", "norminv", "tdist", "tinv", "greatcircledistance", "nameencode", "namedecode", "wkbenvelopexcenter", "wkbenvelopexmax", "wkbenvelopexmin",
    "wkbenvelopeycenter", "wkbenvelopeymax", "wkbenvelopeymin", "datetimenow", "today", "parsetimespan", "rank",
}

SCALARS: dict[str, tuple[int, int, object]] = {}


def scalar(least: int, most: int | None = None, *names: str):
    def add(function):
        for name in names or (function.__name__.strip("_"),):
            SCALARS[name] = (least, least if most is None else most, function)
        return function

    return add


def raise_unless(condition: Column, value: Column, message: str) -> Column:
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message)))


def real(v: Value) -> Column:
    """As double; text that is no number is null."""
    return v.col.try_cast("double") if v.kind == "string" else v.col.cast("double")


def whole(v: Value) -> Column:
    return v.col.cast("long")


def _float(col: Column) -> Value:
    return Value(col, "float")


def divide(n: Column, d: Column) -> Column:
    """IEEE division: by zero gives an infinity or NaN."""
    by_zero = F.when(n.isNull(), None).when((n == 0) | F.isnan(n), F.lit(NAN)).when(n > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(d == 0, by_zero).otherwise(F.try_divide(n, d))


def modulo(n: Column, d: Column) -> Column:
    return F.when(d == 0, F.when(n.isNotNull(), F.lit(NAN))).otherwise(F.try_mod(n, d))


# --- null and conditional


@scalar(1)
def isnull(x):
    return Value(x.col.isNull(), "bool")


@scalar(2, 2, "sn", "coalesce")
def coalesce(a, b):
    return Value(F.coalesce(a.col, b.col), a.kind if a.kind != "null" else b.kind)


# --- text


@scalar(1, 1, "len")
def length(s):
    return Value(F.length(s.col).cast("long"), "int")


@scalar(2)
def left(s, n):
    return Value(F.when(n.col >= 0, F.substr(s.col, F.lit(1), n.col.cast("int"))), "string")


@scalar(2)
def right(s, n):
    n = n.col.cast("int")
    return Value(F.when(n >= 0, F.substr(s.col, F.greatest(F.length(s.col) - n + 1, F.lit(1)), n)), "string")


@scalar(2, 3, "mid", "substring")
def mid(s, i, n=None):
    size = n.col.cast("int") if n else F.length(s.col)
    return Value(F.when((i.col >= 1) & (size >= 0), F.substr(s.col, i.col.cast("int"), size)), "string")


@scalar(3)
def substitute(s, old, new):
    return Value(F.replace(s.col, old.col, new.col), "string")


@scalar(2, 3, "find", "charindex")
def find(needle, hay, start=None):
    at = start.col.cast("int") if start else F.lit(1)
    return Value(F.when(at >= 1, F.call_function("locate", needle.col, hay.col, at).cast("long")), "int")


@scalar(2, 3)
def split(s, sep, i=None):
    parts = F.split(s.col, F.concat(F.lit("\\Q"), sep.col, F.lit("\\E")))
    if i is None:
        return Value(parts, ("list", "string"))
    return Value(F.when(i.col >= 1, F.get(parts, i.col.cast("int") - 1)), "string")


@scalar(2, 3)
def rxextract(s, pattern, group=None):
    return Value(F.when(F.regexp_like(s.col, pattern.col), F.regexp_extract(s.col, str(pattern.literal), int(group.literal) if group else 1)), "string")


@scalar(3)
def rxreplace(s, pattern, new):
    return Value(F.regexp_replace(s.col, pattern.col, new.col), "string")


@scalar(1)
def lower(s):
    return Value(F.lower(s.col), "string")


@scalar(1)
def upper(s):
    return Value(F.upper(s.col), "string")


@scalar(1)
def trim(s):
    return Value(F.regexp_replace(s.col, r"(?U)^\s+|\s+$", ""), "string")


@scalar(1, 99)
def concatenate(*parts):
    return Value(F.concat(*[p.col.cast("string") for p in parts]), "string")


@scalar(1)
def parsereal(s):
    return _float(raise_unless(s.col.isNull() | (s.col == F.btrim(s.col)), s.col.cast("double"), "text is not a number"))


@scalar(1)
def base64encode(s):
    return Value(F.base64(s.col.cast("binary")), "string")


@scalar(1)
def base64decode(s):
    return Value(F.decode(F.to_binary(s.col, F.lit("base64")), "UTF-8"), "string")


# --- numbers; results are doubles

for _name, _f in {"acos": F.acos, "asin": F.asin, "atan": F.atan, "cos": F.cos, "sin": F.sin, "tan": F.tan, "exp": F.exp, "sqrt": F.sqrt, "abs": F.abs}.items():
    SCALARS[_name] = (1, 1, lambda x, f=_f: _float(f(real(x))))


def _integral(f, x: Column) -> Column:
    """``f`` (to a 64 bit integer) of a double; beyond 2^53 a double has no fraction, and NaN and infinity stay."""
    return F.when(F.abs(x) < float(1 << 53), f(x).cast("double")).otherwise(x)


for _name, _f in {"ceiling": F.ceil, "floor": F.floor}.items():
    SCALARS[_name] = (1, 1, lambda x, f=_f: _float(_integral(f, real(x))))


def _log(f):
    def log(x):
        x = real(x)
        return _float(F.when(x == 0, F.lit(-INF)).when(x < 0, F.lit(NAN)).otherwise(f(x)))

    return log


for _name, _f in {"ln": F.ln, "log": F.ln, "log10": F.log10}.items():
    SCALARS[_name] = (1, 1, _log(_f))


@scalar(2)
def atan2(a, b):
    return _float(F.atan2(real(a), real(b)))


@scalar(2)
def power(a, b):
    return _float(F.pow(real(a), real(b)))


@scalar(2)
def mod(a, b):
    return _float(modulo(real(a), real(b)))


@scalar(1, 2, "round")
def round_(x, n=None):
    scale = F.pow(F.lit(10.0), real(n)) if n else F.lit(1.0)
    x = real(x)
    return _float(F.when(F.abs(x) * scale < float(1 << 53), F.signum(x) * _integral(F.floor, F.abs(x) * scale + 0.5) / scale).otherwise(x))


@scalar(0)
def pi():
    return _float(F.pi())


@scalar(2)
def percent(a, b):
    return _float(F.try_divide(real(a), real(b)))


def _draw(seed, order):
    """A number in [0, 1) from the seed and the row's place: the same for every plan and partitioning."""
    return F.pmod(F.xxhash64(whole(seed), order), F.lit(1 << 52)).cast("double") / float(1 << 52)


def rand(seed, order):
    return _float(_draw(seed, order))


def randbetween(low, high, seed, order):
    low, high = whole(low), whole(high)
    return Value(F.when(high >= low, low + F.floor(_draw(seed, order) * (high - low + 1))), "int")


# --- dates and times


def stamp(v: Value) -> Column:
    return v.col.cast("timestamp_ntz")


def micros(v: Value) -> Column:
    return F.unix_micros(stamp(v).cast("timestamp"))


def _part(unit):
    ts = {
        "year": F.year, "quarter": F.quarter, "month": F.month, "day": F.dayofmonth, "dayofmonth": F.dayofmonth, "dayofyear": F.dayofyear, "hour": F.hour, "minute": F.minute,
        "second": lambda c: F.second(c), "week": F.weekofyear, "isoweek": F.weekofyear, "isoyear": lambda c: F.extract(F.lit("YEAROFWEEK"), c), "dayofweek": lambda c: F.weekday(c) + 1, "weekday": lambda c: F.weekday(c) + 1,
    }
    if unit == "millisecond":
        return lambda v: Value(F.pmod(F.floor(micros(v) / 1000), F.lit(1000)).cast("long"), "int")
    if unit not in ts:
        raise FunctionError(f"unknown date part {unit!r}")
    return lambda v: Value(ts[unit](stamp(v)).cast("long"), "int")


for _unit in ("year", "quarter", "month", "day", "dayofmonth", "dayofyear", "hour", "minute", "second", "millisecond", "week", "isoweek", "isoyear", "dayofweek"):
    SCALARS[_unit] = (1, 1, _part(_unit))


@scalar(1)
def yearandweek(d):
    d = stamp(d)
    return Value(F.when(d.isNotNull(), F.format_string("%04d-%02d", F.extract(F.lit("YEAROFWEEK"), d), F.weekofyear(d))), "string")


@scalar(2)
def datepart(unit, d):
    return _part(str(unit.literal).lower())(d)


#: Microseconds of the units that DateAdd and DateDiff know.
UNIT = {"day": 86_400_000_000, "hour": 3_600_000_000, "minute": 60_000_000, "second": 1_000_000, "millisecond": 1_000}


def _unit(v: Value) -> int:
    unit = str(v.literal).lower()
    if unit not in UNIT:
        raise FunctionError(f"unit {v.literal!r} is not one of {', '.join(UNIT)}")
    return UNIT[unit]


@scalar(3)
def dateadd(unit, n, d):
    size = _unit(unit)
    if d.kind == "date":
        if size != UNIT["day"]:
            raise FunctionError("a Date takes whole days only")
        return Value(F.date_add(d.col, n.col.cast("int")), "date")
    return Value(stamp(d) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (whole(n) * size).cast("decimal(24,6)") / 1_000_000), "timestamp")


@scalar(3)
def datediff(unit, a, b):
    difference = micros(b) - micros(a)
    size = _unit(unit)
    return Value(((difference - difference % size) / size).cast("long"), "int")


#: strftime directives and their Java letters (fixed values).
DIRECTIVES = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "p": "a", "b": "MMM", "B": "MMMM", "j": "DDD", "a": "EEE", "A": "EEEE", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "%": "%"}


def java_pattern(pattern: str) -> str:
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "%" and i + 1 < len(pattern):
            if pattern[i + 1] not in DIRECTIVES:
                raise FunctionError(f"unknown date directive %{pattern[i + 1]}")
            out += DIRECTIVES[pattern[i + 1]]
            i += 2
        else:
            out += f"'{c}'" if c.isalpha() else c
            i += 1
    return out


@scalar(1, 2)
def parsedate(s, fmt=None):
    return Value(F.to_date(s.col, java_pattern(fmt.literal)) if fmt else s.col.cast("date"), "date")


@scalar(1, 2)
def parsedatetime(s, fmt=None):
    return Value(F.to_timestamp_ntz(s.col, F.lit(java_pattern(fmt.literal))) if fmt else s.col.cast("timestamp_ntz"), "timestamp")


@scalar(1, 2)
def parsetime(s, fmt=None):
    """Time of day, as a duration since midnight."""
    at = F.to_timestamp_ntz(F.concat(F.lit("1970-01-01 "), s.col), F.lit("yyyy-MM-dd " + (java_pattern(fmt.literal) if fmt else "HH:mm:ss")))
    return Value(at - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), "duration")


@scalar(1)
def toepochseconds(d):
    return Value(F.floor((micros(d) - micros(d) % 1_000_000) / 1_000_000).cast("long"), "int")


@scalar(1)
def toepochmilliseconds(d):
    return Value(F.floor((micros(d) - micros(d) % 1_000) / 1_000).cast("long"), "int")


@scalar(1)
def fromepochseconds(n):
    return Value(F.timestamp_micros(whole(n) * 1_000_000).cast("timestamp_ntz"), "timestamp")


@scalar(1)
def fromepochmilliseconds(n):
    return Value(F.timestamp_micros(whole(n) * 1_000).cast("timestamp_ntz"), "timestamp")


def _interval(us: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), us.cast("decimal(24,6)") / 1_000_000)


def _interval_micros(v: Value) -> Column:
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.unix_micros((zero + v.col).cast("timestamp"))


for _name, _size in {"days": UNIT["day"], "hours": UNIT["hour"], "minutes": UNIT["minute"], "seconds": UNIT["second"], "milliseconds": UNIT["millisecond"]}.items():
    SCALARS[_name] = (1, 1, lambda x, k=_size: Value(_interval(F.round(real(x) * k)), "duration"))
    SCALARS["total" + _name] = (1, 1, lambda v, k=_size: _float(_interval_micros(v).cast("double") / k))


@scalar(5)
def timespan(d, h, m, s, ms):
    """Null beyond 64 bits of microseconds."""
    total = F.lit(0).cast("long")
    for value, unit in ((d, "day"), (h, "hour"), (m, "minute"), (s, "second"), (ms, "millisecond")):
        total = F.try_add(total, F.try_multiply(whole(value), F.lit(UNIT[unit])))
    return Value(_interval(total), "duration")


def _fiscal(part):
    def fiscal(d, offset=None):
        months = whole(offset).cast("int") if offset else F.lit(0)
        return Value(F.when(months >= 0, part(F.add_months(stamp(d).cast("date"), -months)).cast("long")), "int")

    return fiscal


for _name, _f in {"fiscalmonth": F.month, "fiscalquarter": F.quarter, "fiscalyear": F.year}.items():
    SCALARS[_name] = (1, 2, _fiscal(_f))


# --- lists


def _reduced(f):
    def reduce(x):
        numbers = F.filter(F.transform(x.col, lambda v: v.cast("double")), lambda v: v.isNotNull())
        return _float(F.when(x.col.isNotNull(), f(numbers)))

    return reduce


def _total(numbers):
    return F.when(F.size(numbers) > 0, F.aggregate(numbers, F.lit(0.0), lambda a, v: a + v))


SCALARS["listsum"] = (1, 1, _reduced(_total))
SCALARS["listavg"] = (1, 1, _reduced(lambda n: F.try_divide(_total(n), F.size(n))))
SCALARS["listmin"] = (1, 1, _reduced(F.array_min))
SCALARS["listmax"] = (1, 1, _reduced(F.array_max))
SCALARS["listcount"] = (1, 1, lambda x: Value(F.size(F.filter(x.col, lambda v: v.isNotNull())).cast("long"), "int"))
