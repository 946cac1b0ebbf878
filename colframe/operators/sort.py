"""Sorting, top rows and last rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .places import rows_from


def _order(key: str, ascending: bool, nulls_at_end: bool) -> Column:
    c = F.col(f"`{key}`")
    if ascending:
        return c.asc_nulls_last() if nulls_at_end else c.asc_nulls_first()
    return c.desc_nulls_last() if nulls_at_end else c.desc_nulls_first()


def sort(df: DataFrame, keys: list[str], *, sort_ascending: list[bool] | None = None, nulls_at_end: bool = True, stable: bool = False, limit: int | None = None, tasks: int | None = None) -> DataFrame:
    """Rows in the order of the keys. Nulls of all keys go to one end, whatever their directions. ``stable`` keeps the order
    in which rows are read among equal ones. ``limit`` keeps the first rows, or with a negative one the last, sorted. ``tasks`` is the
    number of tasks that sort all rows, a range of keys each; without it Spark merges ranges up to its advisory size."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    up = [True] * len(keys) if sort_ascending is None else list(sort_ascending)
    if not keys:
        raise ValueError("at least one key is needed")
    if len(set(keys)) != len(keys):
        raise ValueError("keys must differ")
    if missing := [k for k in keys if k not in df.columns]:
        raise ValueError(f"no column {missing[0]!r}")
    if len(up) != len(keys):
        raise ValueError("there must be a direction for each key")
    if tasks is not None and limit is not None:
        raise ValueError("tasks sort all rows, without a limit")
    names, place = df.columns, "__place"
    while place in names:
        place += "_"
    rows = df.withColumn(place, F.monotonically_increasing_id()) if stable else df
    order = [_order(k, a, nulls_at_end) for k, a in zip(keys, up, strict=True)] + ([F.col(place)] if stable else [])
    if tasks is not None:
        out = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    elif limit is None or limit >= 0:
        out = rows.orderBy(*order)
        out = out if limit is None else out.limit(limit)
    else:
        back = [_order(k, not a, not nulls_at_end) for k, a in zip(keys, up, strict=True)] + ([F.col(place).desc()] if stable else [])
        out = rows.orderBy(*back).limit(-limit).orderBy(*order)
    return out.select(*[F.col(f"`{c}`") for c in names])


def sorted_slice(df: DataFrame, keys: list[str], offset: int, length: int | None = None, **options) -> DataFrame:
    """``length`` rows of the sorted ones from ``offset`` on; a negative offset counts from the end. Without a ``length`` the sorted
    rows are written with their places, and those from ``offset`` on read from there."""
    if offset < 0:
        out = sort(df, keys, limit=offset, **options)
        return out if length is None else sort(out, keys, limit=min(length, -offset), **options)
    if length is not None and options.get("tasks") is not None:
        raise ValueError("tasks sort all rows, without a limit")
    rows = sort(df, keys, **options)
    if length is None:
        return rows_from(rows, offset) if offset else rows
    return rows.offset(offset).limit(length)
