"""Operators on tables: reference facts, odd cases, bad arguments, plans."""

import math

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colframe.operators import aggregate as agg
from colframe.operators import join as joins
from colframe.operators import tables as tb
from colframe.operators.join import join, join_on
from colframe.operators.sort import sort, sorted_slice
from colframe.plans import lazy
from colframe.sources import io


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---- joins


@pytest.fixture(scope="module")
def sides(spark):
    a = spark.createDataFrame([(3, "s0", 0), (None, "s1", 1), (0, "s2", 2)], "a int, b string, c int")
    b = spark.createDataFrame([(0, "s1", 1), (5, "s0", 4), (3, "s0", 2), (None, "s1", 8)], "d int, e string, f int")
    return a, b


def test_null_keys(sides):
    out = join(*sides, lhs_keys=["a", "b"], rhs_keys=["d", "e"], join_type="LEFT", rhs_out_columns=["f"])
    assert rows(out) == sorted([(3, "s0", 0, 2), (None, "s1", 1, 8), (0, "s2", 2, None)], key=repr)
    out = join(*sides, lhs_keys=["a", "b"], rhs_keys=["d", "e"], nulls_equal=False, rhs_out_columns=["f"])
    assert rows(out) == [(3, "s0", 0, 2)]
    assert rows(join(*sides, lhs_keys=["a"], rhs_keys=["d"], join_type="ANTI")) == []
    assert rows(join(*sides, lhs_keys=["a"], rhs_keys=["d"], join_type="ANTI", nulls_equal=False)) == [(None, "s1", 1)]


@pytest.mark.parametrize("kind", ["INNER", "LEFT", "FULL", "SEMI", "ANTI"])
def test_no_nested_loops(sides, kind):
    assert "NestedLoop" not in plan(join(*sides, lhs_keys=["a"], rhs_keys=["d"], join_type=kind)) and "Cartesian" not in plan(join(*sides, lhs_keys=["a"], rhs_keys=["d"], join_type=kind))


def test_broadcast(sides):
    for side, kinds in (("LEFT", ["INNER"]), ("RIGHT", ["INNER", "LEFT", "SEMI", "ANTI"])):
        for kind in ("INNER", "LEFT", "FULL", "SEMI", "ANTI"):
            if kind in kinds:
                assert "BroadcastHashJoin" in plan(join(*sides, lhs_keys=["a"], rhs_keys=["d"], join_type=kind, broadcast=side))
            else:
                with pytest.raises(RuntimeError):
                    join(*sides, lhs_keys=["a"], rhs_keys=["d"], join_type=kind, broadcast=side)


def test_join_arguments(spark, sides):
    a, b = sides
    for options in ({"lhs_keys": ["a"], "rhs_keys": []}, {"lhs_keys": ["x"], "rhs_keys": ["d"]}, {"lhs_keys": ["a"], "rhs_keys": ["d"], "join_type": "SEMI", "rhs_out_columns": ["f"]}, {"lhs_keys": ["a"], "rhs_keys": ["d"], "join_type": "OUTER"}):
        with pytest.raises(ValueError):  # noqa: PT011
            join(a, b, **options)
    with pytest.raises(ValueError, match="different names"):
        join(a, a, lhs_keys=["a"], rhs_keys=["a"])
    assert join(a, a, lhs_keys=["a"], rhs_keys=["a"], lhs_out_columns=["c"], rhs_out_columns=["b"]).columns == ["c", "b"]
    assert join(a.limit(0), b, lhs_keys=["a"], rhs_keys=["d"], join_type="FULL").count() == 4


def test_join_on(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    b = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert rows(join_on(a, b, left_on=["k"], right_on=["k"], how="full")) == sorted([(1, "a", None), (2, "b", "c"), (3, None, "d")], key=repr)
    assert join_on(a, b, left_on=["k"], right_on=["k"], coalesce=False).columns == ["k", "v", "k_right", "v_right"]
    assert rows(join_on(a, b, left_on=["k"], right_on=["k"], how="right")) == sorted([(2, "b", "c"), (3, None, "d")], key=repr)
    assert join_on(a, b, left_on=[], right_on=[], how="cross").count() == 4


# ---- aggregation


def test_groupby(spark):
    df = spark.createDataFrame([("x", 1, 3.0), ("x", 2, None), ("y", 0, math.nan), ("y", None, 5.0), (None, 4, 1.0)], "k string, a long, b double")
    out = agg.groupby_aggregation(df, ["k"], [("a", "sum", "s"), ("a", "count", "n"), (None, "count_all", "all"), ("a", ("count", {"mode": "all"}), "m"), ("a", ("count_distinct", {"mode": "all"}), "u"), ("a", "product", "p"), ("a", "variance", "v")])
    assert out.columns == ["k", "s", "n", "all", "m", "u", "p", "v"]
    assert rows(out) == sorted([("x", 3, 2, 2, 2, 2, 2, 0.25), ("y", 0, 1, 2, 2, 2, 0, 0.0), (None, 4, 1, 1, 1, 1, 4, 0.0)], key=repr)


def test_product_wraps_and_skips(spark):
    df = spark.createDataFrame([(1, 1 << 40), (1, 1 << 40), (2, None), (3, 3), (3, -5)], "k int, v long")
    assert rows(agg.groupby_aggregation(df, ["k"], [("v", "product", "p")])) == [(1, 0), (2, None), (3, -15)]


def test_groupby_arguments(spark):
    df = spark.createDataFrame([(1, 2)], "k int, v int")
    for keys, requests in (([], [("v", "sum", "s")]), (["k"], [("v", "sum", "k")]), (["k"], [("v", "mode", "m")]), (["k"], [(None, "sum", "s")]), (["k"], [("v", "count_all", "s")]), (["k"], [("w", "sum", "s")]), (["k"], [("v", ("count", {"mode": "odd"}), "s")])):
        with pytest.raises(ValueError):  # noqa: PT011
            agg.groupby_aggregation(df, keys, requests)


def test_partial_aggregation(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 3)
    assert "partial_sum" in plan(agg.groupby_aggregation(df, ["k"], [("id", "sum", "s")]))


def test_reduce(spark):
    df = spark.createDataFrame([(1.0,), (None,), (math.nan,), (4.0,)], "x double")
    one = lambda d, *a, **k: agg.reduce(d, "x", *a, **k).first()[0]
    assert one(df, "max", "float64") == 4.0 and one(df, "min", "float64") == 1.0 and one(df, "count_valid", "int64") == 3
    empty = df.limit(0)
    assert [one(empty, op, "float64") for op in ("sum", "min", "max", "product", "mean")] == [None] * 5
    assert one(empty, "count_valid", "int64") == 0 and one(empty, "any", "bool") is False and one(empty, "all", "bool") is True
    half = spark.createDataFrame([(0.5,)] * 99, "x double")
    assert [one(half, op, "float64", initial=i) for op, i in (("sum", 0.5), ("min", -1.0), ("max", 2.0), ("product", 0.0))] == [50.0, -1.0, 2.0, 0.0]
    assert one(empty, "sum", "float64", initial=2.0) == 2.0 and one(empty, "max", "float64", initial=2.0) == 2.0
    with pytest.raises(ValueError, match="unknown"):
        one(df, "mode", "float64")


# ---- sort


def test_sort_nulls(spark):
    df = spark.createDataFrame([(0, 1), (1, None), (None, 0), (None, None)], "a int, b int")
    assert [tuple(r) for r in sort(df, ["a", "b"], nulls_at_end=False).collect()] == [(None, None), (None, 0), (0, 1), (1, None)]
    assert [tuple(r) for r in sort(df, ["a", "b"], sort_ascending=[False, True]).collect()] == [(1, None), (0, 1), (None, 0), (None, None)]


def test_limits(spark):
    df = spark.range(1000).repartition(5)
    assert [r.id for r in sort(df, ["id"], limit=10).collect()] == list(range(10))
    assert [r.id for r in sort(df, ["id"], limit=-10).collect()] == list(range(990, 1000))
    assert [r.id for r in sorted_slice(df, ["id"], 5, 3).collect()] == [5, 6, 7]
    assert [r.id for r in sorted_slice(df, ["id"], -5, 3).collect()] == [995, 996, 997]
    assert "TakeOrderedAndProject" in plan(sort(df, ["id"], limit=10)) and "TakeOrderedAndProject" in plan(sorted_slice(df, ["id"], 5, 3))


def test_stable(spark):
    df = spark.createDataFrame([(i // 50 % 4, i) for i in range(400)], "k int, at int").coalesce(1)
    out = [tuple(r) for r in sort(df, ["k"], stable=True).collect()]
    assert out == sorted(out) and len(out) == 400
    down = [tuple(r) for r in sort(df, ["k"], sort_ascending=[False], stable=True, limit=-120).collect()]
    assert down == sorted(((i // 50 % 4, i) for i in range(400)), key=lambda x: (-x[0], x[1]))[-120:]


def test_sort_arguments(spark):
    df = spark.range(3)
    for keys, options in (([], {}), (["x"], {}), (["id", "id"], {}), (["id"], {"sort_ascending": [True, False]})):
        with pytest.raises(ValueError):  # noqa: PT011
            sort(df, keys, **options)


# ---- rows, columns, sets


def test_distinct(spark):
    df = spark.createDataFrame([(1, 2, 10), (1, 2, 10), (2, 4, 20), (3, 4, 30), (4, None, 40)], "a int, b int, c int")
    for keys in (["b", "a"], ["a", "b"], ["b", "c"], None):
        assert tb.distinct(df, keys).count() == 4
    nan = spark.createDataFrame([(math.nan,), (math.nan,), (0.0,), (-0.0,), (None,), (None,)], "x double")
    assert tb.distinct(nan).count() == 3
    with pytest.raises(ValueError, match="no column"):
        tb.distinct(df, ["z"])


def test_mask(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "a int, m boolean")
    assert rows(tb.apply_boolean_mask(df, "m")) == [(1, True)]
    with pytest.raises(ValueError, match="boolean"):
        tb.apply_boolean_mask(df, "a")


def test_concat(spark):
    a, b = spark.createDataFrame([(1, "x")], "a int, b string"), spark.createDataFrame([(None, "y")], "a int, b string")
    assert rows(tb.concatenate([a, b])) == sorted([(1, "x"), (None, "y")], key=repr)
    for bad in ([], [a, a.select("b", "a")]):
        with pytest.raises(ValueError):  # noqa: PT011
            tb.concatenate(bad)
    assert tb.concatenate([a, b.select("b", "a")], by_name=True).columns == ["a", "b"]


def test_contains(spark):
    hay, needles = spark.createDataFrame([(1,), (None,), (3,), (3,)], "h int"), spark.createDataFrame([(2,), (3,), (None,)], "n int")
    assert rows(tb.contains(needles, "n", hay, "h")) == sorted([(2, False), (3, True), (None, None)], key=repr)
    with pytest.raises(ValueError, match="one type"):
        tb.contains(needles, "n", hay.select(F.col("h").cast("long")), "h")


def test_select_and_slice(spark):
    df = spark.createDataFrame([(i, -i, str(i)) for i in range(1, 11)], "a int, b int, c string").coalesce(1)
    assert tb.select(df, [2, 0]).columns == ["c", "a"] and tb.select(df, []).count() == 10
    for bad, error in (([0, "a"], TypeError), ([-1], OverflowError), ([9], IndexError), (["z"], IndexError)):
        with pytest.raises(error):
            tb.select(df, bad)
    for a, b in ((None, None), (0, 3), (3, 7), (-8, -2), (1, 1), (2, None), (None, 8), (5, 2), (-100, 2)):
        assert [r.a for r in tb.slice_rows(df, a, b, ["a"]).collect()] == list(range(1, 11))[slice(a, b)]
    with pytest.raises(ValueError, match="different name"):
        tb.table(df, [F.col("a"), F.col("b")], ["x", "x"])
    assert tb.metadata(df)["column_names"] == ["a", "b", "c"] and tb.empty_like(df).count() == 0


def test_zip(spark):
    a, b = spark.range(0, 500, 1, 7).toDF("x"), spark.range(500, 1000, 1, 3).toDF("y")
    assert rows(tb.zip_frames(a, b)) == sorted(((i, i + 500) for i in range(500)), key=repr)
    with pytest.raises(ValueError, match="differ"):
        tb.zip_frames(a, a)


# ---- sources


def test_parquet(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i) if i % 2 else None) for i in range(100)], "a long, b double")
    io.parquet_write(df, f"file://{tmp_path}/p")
    pattern = f"{tmp_path}/p/*.parquet"
    assert rows(io.parquet_read(spark, pattern, columns=["b", "a"])) == sorted(((b, a) for a, b in map(tuple, df.collect())), key=repr)
    assert io.parquet_read(spark, pattern, columns=[]).count() == 100
    for bad in ({"files": pattern, "columns": ["z"]}, {"files": f"{tmp_path}/none*"}):
        with pytest.raises(ValueError):  # noqa: PT011
            io.parquet_read(spark, **bad)
    with pytest.raises(ValueError, match="empty"):
        io.parquet_write(df, f"file://{tmp_path}/p")
    (tmp_path / "q").mkdir()
    io.parquet_write(df, f"file://{tmp_path}/q")
    got = io.parquet_read_array(spark, pattern, columns=["a", "b"], type="float64", null_value=0.5).collect()
    assert sorted(tuple(r[0]) for r in got) == [(float(i), float(i) if i % 2 else 0.5) for i in range(100)]
    with pytest.raises(ValueError, match="different types"):
        io.parquet_read_array(spark, pattern)


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, "x|y"), (None, None, None), (3, -1.0, 'q"u,o')], "a int, b double, c string")
    io.csv_write(df.coalesce(1), f"file://{tmp_path}/c", delimiter="|")
    pattern = f"{tmp_path}/c/*.csv"
    kinds = ["int32", "float64", "string"]
    assert rows(io.csv_read(spark, pattern, dtypes=kinds, delimiter="|")) == rows(df)
    assert io.csv_read(spark, pattern, dtypes=["string", "int32"], delimiter="|", usecols=["c", "a"]).columns == ["a", "c"]
    (tmp_path / "n.csv").write_text("1,2,3\n4,5,6\n")
    out = io.csv_read(spark, f"{tmp_path}/n.csv", dtypes=["int64", "float64"], usecols=[2, 0], names=["z", "x"])
    assert out.columns == ["x", "z"] and rows(out) == [(1.0, 3), (4.0, 6)]
    for bad in ({"dtypes": kinds[:2]}, {"dtypes": kinds, "usecols": ["a", "b", "z"]}, {"dtypes": kinds[:2], "usecols": ["a", "a"]}, {"dtypes": kinds, "delimiter": "||"}, {"dtypes": ["int32"], "usecols": [0]}):
        with pytest.raises(ValueError):  # noqa: PT011
            io.csv_read(spark, pattern, **({"delimiter": "|"} | bad))


def test_arrow(spark):
    table = pa.table({"a": pa.array([1, None], pa.int64()), "b": pa.array(["x", None])})
    assert io.to_arrow(io.from_arrow(spark, table)).to_pydict() == table.to_pydict()
    assert rows(io.from_arrow(spark, pa.scalar(5))) == [(5,)]
    assert io.to_array(io.sequence(spark, 4, 3)).tolist() == [3, 4, 5, 6]
    with pytest.raises(ValueError, match="nulls"):
        io.to_array(io.from_arrow(spark, table))


# ---- lazy frames


def test_lazy(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", math.nan, 2), ("b", None, 3), ("b", None, None)], "k string, x double, n int")
    out = lazy.LazyFrame(df).group_by("k").agg(s=lazy.total(F.col("x")), hi=lazy.greatest(F.col("x")), u=lazy.n_unique(F.col("n")), n=lazy.length()).sort("k")
    a, b = out.df.collect()
    assert math.isnan(a.s) and (a.hi, a.u, a.n) == (1.0, 2, 2) and tuple(b) == ("b", 0.0, None, 2, 2)
    frame = lazy.LazyFrame(spark.range(10).toDF("a")).with_columns(b=F.col("a") * 2).filter(F.col("b") > 4).sort("a", descending=True)
    assert frame.slice(1, 3).collect().to_pydict() == {"a": [8, 7, 6], "b": [16, 14, 12]}
    assert lazy.concat(frame, frame).unique(["a"]).df.count() == 7
    with pytest.raises(ValueError, match="one end"):
        frame.sort("a", "b", nulls_last=[True, False])
    with pytest.raises(ValueError, match="any row"):
        frame.unique(keep="first")


def test_pushdown(spark, data):
    df = tb.apply_boolean_mask(io.parquet_read(spark, [f"{data}/lineitem.parquet"]), F.col("l_quantity") > 45).select("l_orderkey")
    text = plan(df)
    assert "GreaterThan(l_quantity,45.0)" in text and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text


@pytest.mark.parametrize("nulls_equal", [True, False])
@pytest.mark.parametrize("kind", ["INNER", "LEFT", "RIGHT", "FULL", "SEMI", "ANTI"])
def test_join_of_keys_that_repeat(spark, monkeypatch, kind, nulls_equal):
    """Frequent, rare and unmatched keys, nulls, equal rows and maps, two keys of different integer types."""
    monkeypatch.setattr(joins, "BLOCK", 3)
    monkeypatch.setattr(joins, "PAIRS", 20)
    row = F.col("id")
    a = spark.range(60).select(F.when(row % 5 != 0, row % 4).alias("x"), F.when(row % 7 != 0, row % 2).cast("int").alias("y"), F.create_map(F.lit("v"), row % 3).alias("v"))
    b = spark.range(40).select(F.when(row % 3 != 0, row % 6).alias("z"), F.when(row % 9 != 0, row % 2).alias("w"), (row % 2).alias("u"))
    for keys in ((["x"], ["z"]), (["x", "y"], ["z", "w"]), (["y"], ["w"])):
        got, want = (joins.join(a, b, lhs_keys=keys[0], rhs_keys=keys[1], join_type=kind, nulls_equal=nulls_equal, keys_repeat=repeat) for repeat in (True, False))
        assert got.columns == want.columns and got.dtypes == want.dtypes
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_sort_by_tasks(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 3 != 0, F.col("id") % 7).alias("a"), F.col("id").alias("b")).repartition(3)
    for options in ({}, {"nulls_at_end": False}, {"sort_ascending": [False, True]}):
        assert sort(df, ["a", "b"], tasks=9, **options).collect() == sort(df, ["a", "b"], **options).collect()
    assert sort(df.coalesce(1).orderBy("b"), ["a"], stable=True, tasks=9).collect() == sort(df, ["a", "b"]).collect()
    for bad in (lambda: sort(df, ["a"], tasks=9, limit=3), lambda: sorted_slice(df, ["a"], 5, 3, tasks=9)):
        with pytest.raises(ValueError, match="without a limit"):
            bad()
