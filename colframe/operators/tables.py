"""Columns, rows, sets and membership."""

from __future__ import annotations

from functools import reduce as fold
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import operand
from .places import placed, rows_from


def select(df: DataFrame, columns: list) -> DataFrame:
    """Columns by names, or by indices; not both. The order is kept, and no column at all is allowed."""
    if columns and all(isinstance(c, int) and not isinstance(c, bool) for c in columns):
        if any(c < 0 for c in columns):
            raise OverflowError("indices can't be negative")
        if any(c >= len(df.columns) for c in columns):
            raise IndexError("no such column")
        columns = [df.columns[c] for c in columns]
    if not all(isinstance(c, str) for c in columns):
        raise TypeError("columns are given by names or by indices")
    if missing := [c for c in columns if c not in df.columns]:
        raise IndexError(f"no column {missing[0]!r}")
    return df.select(*[F.col(f"`{c}`") for c in columns])


def table(df: DataFrame, columns: list, names: list[str]) -> DataFrame:
    """A table of expressions over ``df`` under new names, which must differ."""
    if len(set(names)) != len(names) or len(names) != len(columns):
        raise ValueError("there must be a different name for each column")
    return df.select(*[operand(c).alias(n) for c, n in zip(columns, names, strict=True)])


def with_columns(df: DataFrame, columns: dict[str, Any]) -> DataFrame:
    """Columns added at the end; those of a known name are replaced where they are."""
    return df.withColumns({n: operand(c) for n, c in columns.items()})


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def apply_boolean_mask(df: DataFrame, mask: Column | str) -> DataFrame:
    """Rows for which the mask is true; null counts as false. ValueError if it isn't boolean."""
    mask = F.col(mask) if isinstance(mask, str) else mask
    if not isinstance(df.select(mask.alias("m")).schema["m"].dataType, T.BooleanType):
        raise ValueError("a mask must be boolean")
    return df.where(mask)


def concatenate(frames: list[DataFrame], by_name: bool = False) -> DataFrame:
    """All rows of tables of one schema (nullability aside); ValueError if there is none, or they differ."""
    if not frames:
        raise ValueError("at least one table is needed")
    first = [(f.name, f.dataType) for f in frames[0].schema]
    for df in frames[1:]:
        own = [(f.name, f.dataType) for f in df.schema]
        if (sorted(own, key=str) != sorted(first, key=str)) if by_name else [k for _, k in own] != [k for _, k in first]:
            raise ValueError("the tables' schemas differ")
    return fold(lambda a, b: a.unionByName(b) if by_name else a.union(b), frames)


def distinct(df: DataFrame, keys: list[str] | None = None, high_cardinality: bool = False) -> DataFrame:
    """One row, any, for each distinct value of the keys (default all columns); nulls are equal, and so are NaNs.
    ``high_cardinality`` is accepted and changes nothing: Spark combines before it shuffles either way."""
    keys = df.columns if keys is None else list(keys)
    if not keys or (missing := [k for k in keys if k not in df.columns]):
        raise ValueError("keys must be columns of the table" if not keys else f"no column {missing[0]!r}")
    return df.dropDuplicates(keys)


def slice_rows(df: DataFrame, start: int | None = None, stop: int | None = None, order: list[str] | None = None) -> DataFrame:
    """Rows ``start`` to ``stop`` as in Python, of the rows in the order of ``order`` (default: as they are read).
    Negative bounds count from the end; that takes one count of the rows. Without a ``stop`` the rows are written with
    their places first, so that what is left of them needn't pass through one task."""
    rows = df.orderBy(*order) if order else df
    a, b = start or 0, stop
    if a < 0 or (b is not None and b < 0):
        a, b, _ = slice(start, stop).indices(df.count())
    if b is None:
        return rows_from(rows, a) if a else rows
    return (rows.offset(a) if a else rows).limit(max(0, b - a))


def contains(df: DataFrame, needles: str, haystack: DataFrame, column: str, name: str = "contained") -> DataFrame:
    """``df`` with a column that says whether each needle is in the haystack's column; null for null needles. Nulls of the
    haystack match nothing. ValueError if types differ.

    The haystack's distinct values are joined; Spark broadcasts them if they turn out to be small."""
    if df.schema[needles].dataType != haystack.schema[column].dataType:
        raise ValueError("needles and haystack must have one type")
    key, mark = "__key", "__mark"
    values = haystack.select(F.col(f"`{column}`").alias(key)).where(F.col(key).isNotNull()).distinct().withColumn(mark, F.lit(True))
    out = df.join(values, F.col(f"`{needles}`") == F.col(key), "left")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], F.when(F.col(f"`{needles}`").isNotNull(), F.col(mark).isNotNull()).alias(name))


def zip_frames(a: DataFrame, b: DataFrame, shorter: bool = False) -> DataFrame:
    """Columns of two tables side by side, by the places at which their rows are read. Names must differ.

    Each table is read once, and its rows written with their places. ValueError if the tables have different numbers of
    rows, unless ``shorter`` says that those beyond the shorter one go."""
    if {*a.columns} & {*b.columns}:
        raise ValueError("names must differ")

    (left, n), (right, m) = placed(a, "__at"), placed(b, "__at")
    if n != m and not shorter:
        raise ValueError(f"the tables have {n} and {m} rows")
    return left.join(right, "__at").drop("__at")


def metadata(df: DataFrame) -> dict:
    """Names and types of the columns, and their number; rows are counted by ``df.count()``."""
    return {"num_columns": len(df.columns), "column_names": list(df.columns), "dtypes": {f.name: f.dataType for f in df.schema}}


def empty_like(df: DataFrame) -> DataFrame:
    return df.limit(0)


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of ``a`` that aren't in ``b``; nulls are equal."""
    return a.subtract(b)
