"""Grouped aggregations and whole-column reductions."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dtypes import is_float, is_integer, to_spark
from ..functions.scalars import wrapped

KINDS = ("sum", "product", "min", "max", "count", "count_all", "mean", "variance", "stddev", "approximate_median", "median", "count_distinct", "n_unique", "first", "last", "any", "all")
#: Factors that a task folds at once in an exact product, and the partial products of a group that meet in one.
FACTORS = 4096


def _mode(options: Any) -> str:
    mode = getattr(options, "mode", None) or (options or {}).get("mode", "only_valid") if isinstance(options, dict) or options is None or hasattr(options, "mode") else str(options)
    if mode not in ("only_valid", "all"):
        raise ValueError(f"unsupported count mode {mode!r}")
    return mode


def _product(x: Column, integer: bool) -> Column:
    """Products of whole numbers are exact and wrap at 64 bits; all-null groups give null.

    As an expression alone, one task folds the values of a group. ``groupby_aggregation`` and ``reduce`` fold parts of
    FACTORS first."""
    if not integer:
        return F.product(x)
    one = F.lit(1).cast("decimal(38,0)")
    return F.when(F.count(x) > 0, F.aggregate(F.collect_list(x.cast("decimal(20,0)")), one, lambda a, v: wrapped(a * v, 64).cast("decimal(38,0)")).cast("long"))


def _products(df: DataFrame, keys: list[Column], factors: dict[str, Column]) -> DataFrame:
    """``keys`` and an exact product of whole numbers by each name: products modulo 2^64 may be taken in any order, so rows
    that stand together are folded first, then partial products by a hash of their place, then those of a group."""
    folded = [_product(F.col(f"`{n}`"), True).alias(n) for n in factors]
    names = [f"__key{i}" for i in range(len(keys))]
    part = F.shiftright(F.col("__row"), FACTORS.bit_length() - 1)
    rows = df.select(*[k.alias(n) for k, n in zip(keys, names, strict=True)], *[x.alias(n) for n, x in factors.items()], F.monotonically_increasing_id().alias("__row"))
    rows = rows.groupBy(*names, part.alias("__part")).agg(*folded)
    rows = rows.groupBy(*names, F.pmod(F.xxhash64("__part"), F.lit(FACTORS)).alias("__part")).agg(*folded)
    return rows.groupBy(*names).agg(*folded)


def aggregate(kind: str, x: Column | None, options: Any = None, source: Any = None) -> Column:
    """The expression of an aggregation. ``variance`` and ``stddev`` are those of a population. ``median`` is exact, and
    keeps the counts of a group's distinct values in one task; so is ``approximate_median``, unless an option ``accuracy``
    asks for a sketch of bounded size, whose rank is off by the number of rows over that. ``source`` is the column's type
    (products need it)."""
    if kind in ("approximate_median", "median"):
        accuracy = options.get("accuracy") if isinstance(options, dict) and kind != "median" else None
        return F.approx_percentile(x, 0.5, accuracy) if accuracy else F.median(x)
    if kind in ("any", "all"):
        return (F.bool_or if kind == "any" else F.bool_and)(x.cast("boolean"))
    simple = {"sum": F.sum, "min": F.min, "max": F.max, "mean": F.avg, "variance": F.var_pop, "stddev": F.stddev_pop, "first": F.first, "last": F.last}
    if kind in simple:
        return simple[kind](x)
    if kind == "product":
        return _product(x, source is not None and is_integer(source))
    if kind == "count_all":
        return F.count(F.lit(1))
    if kind == "count":
        return F.count(F.lit(1)) if _mode(options) == "all" else F.count(x)
    if kind == "count_distinct":
        return F.count_distinct(x) + F.max(x.isNull().cast("long")) if _mode(options) == "all" else F.count_distinct(x)
    if kind == "n_unique":
        return F.count_distinct(x) + F.max(x.isNull().cast("long"))
    raise ValueError(f"unknown aggregation {kind!r}; known: {', '.join(KINDS)}")


def groupby_aggregation(df: DataFrame, keys: list[str], requests: list[tuple]) -> DataFrame:
    """``requests``: ``(column, kind, name)`` or ``(column, (kind, options), name)``; the column of ``count_all`` is None.

    Keys come first, then the aggregates in the order asked for. Nulls and NaNs are keys like others."""
    if not keys:
        raise ValueError("at least one key is needed")
    names = [*keys, *(r[2] for r in requests)]
    if len(set(names)) != len(names):
        raise ValueError("names of keys and aggregates must differ")
    out, factors = [], {}
    for column, kind, name in requests:
        kind, options = kind if isinstance(kind, tuple) else (kind, None)
        if (column is None) != (kind == "count_all"):
            raise ValueError("count_all takes no column, and others take one")
        if column is not None and column not in df.columns:
            raise ValueError(f"no column {column!r}")
        source = df.schema[column].dataType if column else None
        if kind == "product" and is_integer(source):
            factors[name] = F.col(f"`{column}`")
        else:
            out.append(aggregate(kind, F.col(f"`{column}`") if column else None, options, source).alias(name))
    by = [F.col(f"`{k}`") for k in keys]
    if not factors:
        return df.groupBy(*by).agg(*out) if out else df.select(*by).distinct()
    products, inner = _products(df, by, factors), [f"__key{i}" for i in range(len(keys))]
    if out:
        others = df.groupBy(*by).agg(*out)
        same = [others[f"`{k}`"].eqNullSafe(products[n]) for k, n in zip(keys, inner, strict=True)]
        return others.join(products, same).select(*[F.col(f"`{n}`") for n in names])
    return products.select(*[F.col(n).alias(k) for k, n in zip(keys, inner, strict=True)], *[F.col(f"`{n}`") for n in factors])


REDUCTIONS = ("sum", "product", "min", "max", "mean", "count_valid", "any", "all")


def reduction(x: Column, op: str, output_type: Any, initial: Any = None, source: Any = None) -> Column:
    """The expression of ``reduce``, for use in ``agg`` with others."""
    to = to_spark(output_type)
    floats = source is None or is_float(to_spark(source))
    # NaN is no minimum or maximum; a column of nothing else has none
    y = F.when(~F.isnan(x), x) if floats and op in ("min", "max") else x
    simple = {"sum": F.sum, "min": F.min, "max": F.max, "mean": F.avg, "count_valid": F.count}
    if op in simple:
        out = simple[op](y)
    elif op == "product":
        out = _product(y, is_integer(to_spark(source)) if source is not None else False)
    elif op in ("any", "all"):
        empty = F.lit(op == "all")
        out = F.coalesce((F.bool_or if op == "any" else F.bool_and)(x.cast("boolean")), empty)
    else:
        raise ValueError(f"unknown reduction {op!r}; known: {', '.join(REDUCTIONS)}")
    if initial is not None:
        start = F.lit(initial)
        if op == "sum":
            out = F.coalesce(out, F.lit(0)) + start
        elif op == "product":
            out = F.coalesce(out, F.lit(1)) * start
        elif op in ("min", "max"):
            out = (F.least if op == "min" else F.greatest)(out, start)
        else:
            raise ValueError(f"{op} takes no initial value")
    return out.cast(to)


def reduce(df: DataFrame, column: str, op: str, output_type: Any, initial: Any = None) -> DataFrame:
    """One row with ``column`` reduced. Nulls are skipped; sum, product, min, max and mean of nothing are null, counts 0,
    ``any`` false and ``all`` true. ``initial`` counts as one more value."""
    source = df.schema[column].dataType
    if op == "product" and is_integer(source):
        df = _products(df, [], {column: F.col(f"`{column}`")})
    return df.agg(reduction(F.col(f"`{column}`"), op, output_type, initial, source).alias(column))
