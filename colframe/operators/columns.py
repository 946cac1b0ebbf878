"""Functions of columns that check their types: forms of the element-wise functions that see the table's schema."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dtypes import to_spark
from ..functions import scalars, strings, timestamps


def _kind(df: DataFrame, x: Any) -> T.DataType | None:
    """The type of a column of ``df``, by name or as an expression, or of a scalar; that of a null scalar is None."""
    x = F.col(f"`{x}`") if isinstance(x, str) and x in df.columns else x
    kind = df.select((x if isinstance(x, Column) else F.lit(x)).alias("x")).schema["x"].dataType
    return None if isinstance(kind, T.NullType) else kind


def _of(df: DataFrame, name: str) -> T.DataType:
    if name not in df.columns:
        raise ValueError(f"no column {name!r}")
    return df.schema[name].dataType


def match(df: DataFrame, column: str, name: str, pattern: str, to: str) -> DataFrame:
    """``df`` with the column ``to``, as by ``strings.match``; ValueError if the column isn't of strings."""
    if not isinstance(_of(df, column), T.StringType):
        raise ValueError("only strings can be matched")
    return df.withColumn(to, strings.match(name, F.col(f"`{column}`"), pattern))


def to_timestamps(df: DataFrame, column: str, timestamp_type: Any, format_: str, to: str) -> DataFrame:
    """``df`` with strings as timestamps of a type; ValueError if the column isn't of strings, or the type no timestamp."""
    if not isinstance(_of(df, column), T.StringType):
        raise ValueError("only strings become timestamps")
    return df.withColumn(to, timestamps.to_timestamps(F.col(f"`{column}`"), format_, timestamp_type=timestamp_type))


def extract_timestamp_component(df: DataFrame, column: str, component: str, to: str) -> DataFrame:
    """``df`` with a component as bigint; ValueError if the column isn't of timestamps."""
    if not isinstance(_of(df, column), (T.TimestampType, T.TimestampNTZType)):
        raise ValueError("only timestamps have components")
    return df.withColumn(to, timestamps.extract(F.col(f"`{column}`"), component))


def replace_nulls(df: DataFrame, column: str, value: Any, to: str, kind: Any = None) -> DataFrame:
    """``df`` with nulls replaced by a scalar, of type ``kind`` if that is given; ValueError if its type isn't the column's. A
    Python int, float or str has the column's type if that is of whole numbers, floats or strings."""
    own = _of(df, column)
    given = to_spark(kind) if kind is not None else _kind(df, value)
    if kind is None and isinstance(given, (T.IntegralType, T.FractionalType, T.StringType)):
        same = next(k for k in (T.IntegralType, T.FractionalType, T.StringType) if isinstance(given, k))
        given = own if isinstance(own, same) else given
    if given is not None and given != own:
        raise ValueError(f"the column is of {own.simpleString()}, the value of {given.simpleString()}")
    return df.withColumn(to, scalars.fill_null(F.col(f"`{column}`"), value, own))


def copy_if_else(df: DataFrame, cond: Any, lhs: Any, rhs: Any, to: str) -> DataFrame:
    """``df`` with ``lhs`` where the condition is true and else ``rhs``, which are columns or scalars of one type; ValueError if
    they aren't, or the condition isn't boolean."""
    if not isinstance(_kind(df, cond), T.BooleanType):
        raise ValueError("a condition must be boolean")
    kinds = {k for x in (lhs, rhs) if (k := _kind(df, x)) is not None}
    if len(kinds) > 1:
        raise ValueError("both sides must have one type")
    column = {id(x): F.col(f"`{x}`") if isinstance(x, str) and x in df.columns else x for x in (cond, lhs, rhs)}
    return df.withColumn(to, scalars.if_else(column[id(cond)], column[id(lhs)], column[id(rhs)]))
