"""A lazy frame: query steps in the manner of a plan, put together as one Spark plan."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars, timestamps
from ..operators import join as joins
from ..operators import sort as sorts
from ..operators import tables
from ..sources import io


class LazyFrame:
    """Steps over a DataFrame. Nothing runs before ``collect``; Catalyst optimizes all steps together."""

    def __init__(self, df: DataFrame):
        self.df = df

    def _of(self, df: DataFrame) -> LazyFrame:
        return LazyFrame(df)

    def select(self, *columns: Any, **named: Any) -> LazyFrame:
        return self._of(self.df.select(*columns, *[tables.operand(v).alias(k) for k, v in named.items()]))

    def with_columns(self, **named: Any) -> LazyFrame:
        return self._of(tables.with_columns(self.df, named))

    def filter(self, predicate: Column) -> LazyFrame:
        return self._of(tables.apply_boolean_mask(self.df, predicate))

    def group_by(self, *keys: Any) -> GroupBy:
        return GroupBy(self, keys)

    def join(self, other: LazyFrame, left_on: list[str], right_on: list[str], how: str = "inner", suffix: str = "_right", coalesce: bool = True, nulls_equal: bool = False) -> LazyFrame:
        return self._of(joins.join_on(self.df, other.df, left_on=left_on, right_on=right_on, how=how, suffix=suffix, coalesce=coalesce, nulls_equal=nulls_equal))

    def sort(self, *keys: str, descending: bool | list[bool] = False, nulls_last: bool | list[bool] = False, maintain_order: bool = False) -> LazyFrame:
        down = [descending] * len(keys) if isinstance(descending, bool) else list(descending)
        last = {nulls_last} if isinstance(nulls_last, bool) else set(nulls_last)
        if len(last) != 1:
            raise ValueError("nulls of all keys go to one end")
        return self._of(sorts.sort(self.df, list(keys), sort_ascending=[not d for d in down], nulls_at_end=last.pop(), stable=maintain_order))

    def slice(self, offset: int, length: int | None = None) -> LazyFrame:
        if offset < 0:
            stop = None if length is None or length >= -offset else offset + length
            return self._of(tables.slice_rows(self.df, offset, stop))
        return self._of(tables.slice_rows(self.df, offset, None if length is None else offset + length))

    def unique(self, subset: list[str] | None = None, keep: str = "any", maintain_order: bool = False) -> LazyFrame:
        if keep != "any" or maintain_order:
            raise ValueError("only any row of equal ones is kept, in no order")
        return self._of(tables.distinct(self.df, subset))

    def tail(self, n: int) -> LazyFrame:
        """The last rows, in the order in which rows are read."""
        return self.slice(-n, None)

    def cache(self) -> LazyFrame:
        return self._of(self.df.cache())

    def pipe(self, step: Callable[[DataFrame], DataFrame]) -> LazyFrame:
        return self._of(step(self.df))

    def collect(self):
        """All rows as an Arrow table."""
        return self.df.toArrow()

    def explain(self) -> None:
        self.df.explain("formatted")


class GroupBy:
    def __init__(self, frame: LazyFrame, keys: tuple):
        self.frame, self.keys = frame, keys

    def agg(self, **named: Column) -> LazyFrame:
        """Aggregates may stand inside arithmetic, and arithmetic inside them."""
        return LazyFrame(self.frame.df.groupBy(*self.keys).agg(*[v.alias(k) for k, v in named.items()]))


def scan_parquet(spark: SparkSession, files: Any, columns: list[str] | None = None, predicate: Column | None = None) -> LazyFrame:
    """Parquet files as a lazy frame; the predicate and the choice of columns go down to the scan."""
    frame = LazyFrame(io.parquet_read(spark, files))
    frame = frame if predicate is None else frame.filter(predicate)
    return frame if columns is None else LazyFrame(tables.select(frame.df, columns))


def scan_csv(spark: SparkSession, files: Any, dtypes: list, **options: Any) -> LazyFrame:
    """CSV files as a lazy frame, read as by ``csv_read``."""
    return LazyFrame(io.csv_read(spark, files, dtypes=dtypes, **options))


def from_frame(spark: SparkSession, data: Any) -> LazyFrame:
    """An Arrow or pandas table in the driver's memory as a lazy frame."""
    return LazyFrame(data if isinstance(data, DataFrame) else io.from_arrow(spark, data))


def concat(*frames: LazyFrame) -> LazyFrame:
    return LazyFrame(tables.concatenate([f.df for f in frames], by_name=True))


# aggregates of the lazy path: sums of nothing are 0, minima and maxima leave NaN out, and null is a value of its own


def total(x: Column) -> Column:
    return F.coalesce(F.sum(x), F.lit(0))


def least(x: Column) -> Column:
    return F.min(F.when(~scalars.is_nan(x), x))


def greatest(x: Column) -> Column:
    return F.max(F.when(~scalars.is_nan(x), x))


def only(x: Column, condition: Column) -> Column:
    """The values that an aggregate sees: those of rows where the condition is true."""
    return F.when(condition, x)


def n_unique(x: Column) -> Column:
    return F.count_distinct(x) + F.coalesce(F.max(x.isNull().cast("long")), F.lit(0))


def first(x: Column, order: Column) -> Column:
    """The value of the first row in an order, null if it is null there."""
    return F.min_by(x, order)


def last(x: Column, order: Column) -> Column:
    return F.max_by(x, order)


def length() -> Column:
    return F.count(F.lit(1))


# components of timestamps as the lazy path has them: parts of the second add up


def millisecond(x: Column) -> Column:
    return timestamps.extract(x, "millisecond").cast("int")


def microsecond(x: Column) -> Column:
    return (timestamps.extract(x, "millisecond") * 1000 + timestamps.extract(x, "microsecond")).cast("int")


def nanosecond(x: Column) -> Column:
    return (timestamps.extract(x, "millisecond") * 1_000_000 + timestamps.extract(x, "microsecond") * 1000 + timestamps.extract(x, "nanosecond")).cast("int")


