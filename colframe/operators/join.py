"""Equi-joins."""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dtypes import is_integer
from .places import many_tasks

TYPES = {"INNER": "inner", "LEFT": "left", "FULL": "full", "SEMI": "left_semi", "ANTI": "left_anti", "RIGHT": "right", "CROSS": "cross"}
#: Joins in which a side may be broadcast.
BROADCASTS = {"LEFT": ("INNER",), "RIGHT": ("INNER", "LEFT", "SEMI", "ANTI")}
#: Rows of a side in a block, and pairs of rows from which on a key is joined in blocks.
BLOCK, PAIRS = 1024, 1 << 16


def _equal(xs: list[str], ys: list[str], nulls_equal: bool) -> Column:
    return fold(lambda x, y: x & y, [F.col(x).eqNullSafe(F.col(y)) if nulls_equal else F.col(x) == F.col(y) for x, y in zip(xs, ys, strict=True)])


def _in_blocks(a: DataFrame, b: DataFrame, a_keys: list[str], b_keys: list[str], kind: str, nulls_equal: bool) -> DataFrame:
    """The join of sides whose keys repeat on both. A key of more than ``PAIRS`` pairs is split into blocks of some ``BLOCK`` rows
    of either side, each pair of which can go to a task of its own. As all rows of such a key have a match, they are an inner join whatever
    the type; the other keys are joined as usual. There are no more keys to broadcast than a ``PAIRS``-th of the rows that come out."""
    xs, ys = [f"x{i}" for i in range(len(a_keys))], [f"y{i}" for i in range(len(b_keys))]
    x = a.groupBy(*[F.col(k).alias(n) for k, n in zip(a_keys, xs, strict=True)]).agg(F.count(F.lit(1)).alias("n"))
    y = b.groupBy(*[F.col(k).alias(n) for k, n in zip(b_keys, ys, strict=True)]).agg(F.count(F.lit(1)).alias("m"))
    many = x.join(y, _equal(xs, ys, nulls_equal)).where(F.col("n").cast("double") * F.col("m") > PAIRS)
    # a struct equals another of the same fields, nulls among them
    many = F.broadcast(many.select(*xs, F.struct(*xs).alias("key"), F.ceil(F.col("n") / BLOCK).cast("int").alias("n"), F.ceil(F.col("m") / BLOCK).cast("int").alias("m")))
    tasks = many_tasks(a.sparkSession)

    def side(df: DataFrame, keys: list[str], own: str, parts: str, other: str, copies: str) -> DataFrame:
        rows = df.join(many, _equal(keys, xs, nulls_equal)).drop(*xs).repartition(tasks)
        # the task keeps equal rows apart; unlike a random number it is the same when a task runs again
        hashed = F.xxhash64(F.spark_partition_id(), *[F.col(n) for n, t in df.dtypes if "map<" not in t and "variant" not in t])
        rows = rows.withColumn(own, F.pmod(hashed, F.col(parts)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(copies) - 1)))
        return rows.drop("n", "m").repartition(tasks, "key", "i", "j")

    blocks = side(a, a_keys, "i", "n", "j", "m").join(side(b, b_keys, "j", "m", "i", "n"), ["key", "i", "j"])
    few = [df.join(many, _equal(keys, xs, nulls_equal), "left_anti") for df, keys in ((a, a_keys), (b, b_keys))]
    return blocks.select(*a.columns, *b.columns).union(few[0].join(few[1], _equal(a_keys, b_keys, nulls_equal), TYPES[kind]))


def _same_kind(a: T.DataType, b: T.DataType) -> bool:
    return a == b or (is_integer(a) and is_integer(b))


def join(lhs: DataFrame, rhs: DataFrame, *, lhs_keys: list[str], rhs_keys: list[str], join_type: str = "INNER", lhs_out_columns: list[str] | None = None, rhs_out_columns: list[str] | None = None, nulls_equal: bool = True, broadcast: str = "AUTO", keys_repeat: bool = False) -> DataFrame:
    """Rows whose keys are equal by position. Null keys are equal to each other, or with ``nulls_equal=False`` to nothing.

    The output has the columns asked for (default all) of the left side, then of the right one; all names must differ. SEMI
    and ANTI keep left rows with and without a match and have no right columns. ``broadcast`` is AUTO, by which Spark broadcasts a
    side of a known small size, or the side that the caller knows to be small, whose size isn't checked: LEFT for INNER,
    RIGHT for all but FULL. ``keys_repeat`` says that single keys may have many rows on both sides, so far more come out than go in:
    the pairs of a frequent key are then shared among tasks, for a count of the keys of both sides. It does nothing for SEMI and ANTI,
    with a side to broadcast, or if two keys have types that aren't the same and not both integers."""
    kind, broadcast = join_type.upper(), broadcast.upper()
    if kind not in TYPES or kind == "CROSS":
        raise ValueError(f"unknown join type {join_type!r}")
    if len(lhs_keys) != len(rhs_keys) or not lhs_keys:
        raise ValueError("both sides need as many keys, at least one")
    if broadcast != "AUTO" and broadcast not in BROADCASTS:
        raise ValueError(f"unknown broadcast {broadcast!r}")
    if broadcast != "AUTO" and kind not in BROADCASTS[broadcast]:
        raise RuntimeError(f"the {broadcast.lower()} side of a {kind} join can't be broadcast")
    one_side = kind in ("SEMI", "ANTI")
    if one_side and rhs_out_columns:
        raise ValueError(f"a {kind} join has no columns of the right side")
    left = list(lhs.columns if lhs_out_columns is None else lhs_out_columns)
    right = [] if one_side else list(rhs.columns if rhs_out_columns is None else rhs_out_columns)
    for df, names in ((lhs, [*left, *lhs_keys]), (rhs, [*right, *rhs_keys])):
        if missing := [n for n in names if n not in df.columns]:
            raise ValueError(f"no column {missing[0]!r}")
    if len({*left, *right}) != len(left) + len(right):
        raise ValueError("output columns must have different names")
    # names of both sides may clash inside: each side gets names of its own
    a = lhs.select(*[F.col(f"`{n}`").alias(f"l{i}") for i, n in enumerate(dict.fromkeys([*left, *lhs_keys]))])
    b = rhs.select(*[F.col(f"`{n}`").alias(f"r{i}") for i, n in enumerate(dict.fromkeys([*right, *rhs_keys]))])
    at, bt = ({n: f"{p}{i}" for i, n in enumerate(dict.fromkeys(names))} for p, names in (("l", [*left, *lhs_keys]), ("r", [*right, *rhs_keys])))
    a, b = F.broadcast(a) if broadcast == "LEFT" else a, F.broadcast(b) if broadcast == "RIGHT" else b
    a_keys, b_keys = [at[n] for n in lhs_keys], [bt[n] for n in rhs_keys]
    if keys_repeat and not one_side and broadcast == "AUTO" and all(_same_kind(a.schema[x].dataType, b.schema[y].dataType) for x, y in zip(a_keys, b_keys, strict=True)):
        out = _in_blocks(a, b, a_keys, b_keys, kind, nulls_equal)
    else:
        out = a.join(b, _equal(a_keys, b_keys, nulls_equal), TYPES[kind])
    return out.select(*[F.col(at[n]).alias(n) for n in left], *[F.col(bt[n]).alias(n) for n in right])


def join_on(lhs: DataFrame, rhs: DataFrame, *, left_on: list[str], right_on: list[str], how: str = "inner", suffix: str = "_right", coalesce: bool = True, nulls_equal: bool = False) -> DataFrame:
    """A join that renames clashing right columns with ``suffix`` and, with ``coalesce``, leaves out the right keys; a full
    join then takes each key from the side that has it. ``how`` may also be right or cross."""
    if how == "cross":
        return lhs.crossJoin(rhs.toDF(*[f"{c}{suffix}" if c in lhs.columns else c for c in rhs.columns]))
    renamed = rhs.toDF(*[f"{c}{suffix}" if c in lhs.columns else c for c in rhs.columns])
    keys = [f"{c}{suffix}" if c in lhs.columns else c for c in right_on]
    out = join(lhs, renamed, lhs_keys=left_on, rhs_keys=keys, join_type=how, nulls_equal=nulls_equal)
    if how in ("semi", "anti") or not coalesce:
        return out
    whole = {a: F.coalesce(F.col(f"`{a}`"), F.col(f"`{b}`")) for a, b in zip(left_on, keys, strict=True)} if how in ("full", "right") else {}
    return out.select(*[whole.get(c, F.col(f"`{c}`")).alias(c) for c in out.columns if c not in keys])
