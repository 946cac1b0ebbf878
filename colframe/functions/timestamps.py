"""Strings to timestamps, and components of timestamps."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scalars import col

#: Strptime specifiers and the patterns that Spark has for them.
SPECIFIERS = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "p": "a", "M": "mm", "S": "ss", "f": "SSSSSS", "z": "xx", "j": "DDD"}
COMPONENTS = ("year", "month", "day", "day_of_week", "hour", "minute", "second", "millisecond", "microsecond", "nanosecond")


def spark_pattern(format_: str) -> str:
    """A strptime format as a Spark date pattern; ValueError for a specifier without one (weeks and weekdays)."""
    out, literal, at = [], [], 0

    def flush():
        if literal:
            out.append("'" + "".join(literal).replace("'", "''") + "'" if any(c.isalpha() or c in "'#{}[]" for c in literal) else "".join(literal))
            literal.clear()

    while at < len(format_):
        c = format_[at]
        if c == "%":
            name = format_[at + 1 : at + 2]
            if name == "%":
                literal.append("%")
            elif name in SPECIFIERS:
                flush()
                out.append(SPECIFIERS[name])
            else:
                raise ValueError(f"unsupported specifier %{name}")
            at += 2
        else:
            literal.append(c)
            at += 1
    flush()
    return "".join(out)


#: Units of timestamp types, and what finer parts are cut to; nanoseconds are kept as microseconds.
UNITS = {"s": "second", "ms": "millisecond", "us": None, "ns": None}


def unit_and_zone(timestamp_type: Any) -> tuple[str, bool]:
    """Unit of a timestamp type (of Arrow, NumPy or Spark, or a name), and whether it has a time zone; ValueError for others."""
    if isinstance(timestamp_type, T.DataType):
        if not isinstance(timestamp_type, (T.TimestampType, T.TimestampNTZType)):
            raise ValueError(f"not a timestamp type: {timestamp_type!r}")
        return "us", isinstance(timestamp_type, T.TimestampType)
    found = re.fullmatch(r"(?:timestamp|datetime64)\[(s|ms|us|ns)(, *tz=[^\]]+)?\]", str(timestamp_type))
    if not found:
        raise ValueError(f"not a timestamp type: {timestamp_type!r}")
    return found[1], bool(found[2])


def to_timestamps(x: Any, format_: str, tz: bool = False, timestamp_type: Any = None) -> Column:
    """Strings parsed by a strptime format; what doesn't parse is null. Two-digit years from 69 on are of the 1900s. With a
    ``timestamp_type``, parts of a second beyond its unit are cut off."""
    x, pattern, unit = col(x), spark_pattern(format_), None
    if timestamp_type is not None:
        unit, tz = unit_and_zone(timestamp_type)
    # a parse that fails is null, whatever the mode
    out = F.try_to_timestamp(x, F.lit(pattern))
    if "%y" in format_:
        out = F.when(F.year(out) >= 2069, out - F.make_ym_interval(F.lit(100))).otherwise(out)
    if unit and UNITS[unit]:
        out = F.date_trunc(UNITS[unit], out)
    return out if tz else out.cast("timestamp_ntz")


def extract(x: Any, component: str) -> Column:
    """A component as bigint. Monday is day_of_week 1. Milliseconds and microseconds are those within the second;
    nanoseconds are 0, as Spark keeps microseconds."""
    x = col(x)
    within = F.extract(F.lit("SECOND"), x) * 1_000_000 % 1_000_000
    parts = {
        "year": lambda: F.year(x), "month": lambda: F.month(x), "day": lambda: F.dayofmonth(x), "day_of_week": lambda: F.weekday(x) + 1,
        "hour": lambda: F.hour(x), "minute": lambda: F.minute(x), "second": lambda: F.second(x),
        "millisecond": lambda: F.floor(within / 1000), "microsecond": lambda: within.cast("bigint") % 1000, "nanosecond": lambda: F.when(x.isNotNull(), F.lit(0)),
        "day_of_year": lambda: F.dayofyear(x),
    }
    if component not in parts:
        raise ValueError(f"unknown component {component!r}; known: {', '.join(COMPONENTS)}")
    return parts[component]().cast("bigint")
