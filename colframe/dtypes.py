"""Type-likes (Arrow, NumPy, names, Spark) as Spark types.

Spark has no unsigned, nanosecond or time-of-day columns: unsigned integers become the next wider signed type
(uint64 decimal(20,0)), timestamps are microseconds (with a zone TimestampType, without TimestampNTZType), durations are
day-time intervals, and times of day are microseconds as bigint.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import types as T

NAMES: dict[str, T.DataType] = {
    "bool": T.BooleanType(), "boolean": T.BooleanType(),
    "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
    "float32": T.FloatType(), "float": T.FloatType(), "float64": T.DoubleType(), "double": T.DoubleType(),
    "string": T.StringType(), "large_string": T.StringType(), "str": T.StringType(), "utf8": T.StringType(),
    "date32": T.DateType(), "date64": T.DateType(), "date32[day]": T.DateType(), "date64[ms]": T.DateType(),
}
INTEGER_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def to_spark(kind: Any) -> T.DataType:
    """The Spark type of a Spark, pyarrow or NumPy type, a Python class, or a type's name; TypeError if there is none."""
    if isinstance(kind, T.DataType):
        return kind
    if kind in (bool, int, float, str):
        return {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}[kind]
    name = str(getattr(kind, "name", None) or kind) if not isinstance(kind, type) else kind.__name__
    name = str(kind) if type(kind).__module__.startswith("pyarrow") else name
    if name in NAMES:
        return NAMES[name]
    if name.startswith(("timestamp", "datetime64")):
        return T.TimestampType() if "tz=" in name else T.TimestampNTZType()
    if name.startswith(("duration", "timedelta64")):
        return T.DayTimeIntervalType()
    if name.startswith(("time32", "time64")):
        return T.LongType()
    try:
        return T.DataType.fromDDL(name)
    except Exception as e:
        raise TypeError(f"unsupported type: {kind!r}") from e


def is_integer(kind: T.DataType) -> bool:
    return type(kind) in INTEGER_BITS


def is_float(kind: T.DataType) -> bool:
    return isinstance(kind, (T.FloatType, T.DoubleType))
