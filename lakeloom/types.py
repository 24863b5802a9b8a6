"""Type names of definitions and expressions, and their Spark types."""

from __future__ import annotations

import re

from pyspark.sql import types as T

#: Names in definitions (fixed values); INTEGER is 32 bits wide.
NAMES = {
    "bool": T.BooleanType(), "boolean": T.BooleanType(),
    "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "tinyint": T.ByteType(), "smallint": T.ShortType(), "integer": T.IntegerType(), "int": T.IntegerType(), "bigint": T.LongType(), "long": T.LongType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
    "float32": T.FloatType(), "float64": T.DoubleType(), "float": T.FloatType(), "real": T.FloatType(), "double": T.DoubleType(),
    "string": T.StringType(), "varchar": T.StringType(), "text": T.StringType(), "utf8": T.StringType(),
    "date": T.DateType(), "date32": T.DateType(),
    "timestamp": T.TimestampNTZType(), "datetime": T.TimestampNTZType(), "timestamp_us": T.TimestampNTZType(), "timestamp_utc": T.TimestampType(),
    "duration": T.DayTimeIntervalType(), "decimal": T.DecimalType(38, 10),
}


def spark_type(name: str) -> T.DataType:
    """Spark type of a name such as ``int64``, ``decimal(12,2)`` or ``list<float64>``."""
    text = name.strip().lower()
    if text in NAMES:
        return NAMES[text]
    if m := re.fullmatch(r"decimal(?:128)?\((\d+),\s*(\d+)\)", text):
        return T.DecimalType(int(m[1]), int(m[2]))
    if m := re.fullmatch(r"(?:list|array)<(.+)>", text):
        inner = spark_type(m[1])
        if isinstance(inner, T.ArrayType):
            raise ValueError(f"nested lists are not supported: {name}")
        return T.ArrayType(inner, True)
    raise ValueError(f"unknown type {name!r}")


def kind_of(data_type: T.DataType):
    """Kind used by the expression compiler: bool, int, float, string, date, timestamp, duration, decimal, null, or ("list", kind)."""
    if isinstance(data_type, T.ArrayType):
        return ("list", kind_of(data_type.elementType))
    for kind, types in {
        "bool": (T.BooleanType,), "int": (T.ByteType, T.ShortType, T.IntegerType, T.LongType), "float": (T.FloatType, T.DoubleType), "string": (T.StringType,),
        "date": (T.DateType,), "timestamp": (T.TimestampType, T.TimestampNTZType), "duration": (T.DayTimeIntervalType,), "decimal": (T.DecimalType,), "null": (T.NullType,),
    }.items():
        if isinstance(data_type, types):
            return kind
    return "other"
