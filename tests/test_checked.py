"""Type checks, places, exact products, and what the lazy front end adds."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from colframe.functions import scalars as s
from colframe.functions import timestamps as ts
from colframe.operators import aggregate as agg
from colframe.operators import columns as cols
from colframe.operators import tables as tb
from colframe.operators.sort import sorted_slice
from colframe.plans import lazy
from colframe.sources import io


@pytest.fixture(scope="module")
def mixed(spark):
    return spark.createDataFrame([(1, "a", 1.0, True), (2, None, math.nan, None), (None, "c", None, False)], "n long, t string, x double, b boolean").withColumn("at", F.lit("2020-01-02 03:04:05.678901").cast("timestamp_ntz"))


def test_types_are_checked(mixed):
    for call in (
        lambda: cols.match(mixed, "n", "starts_with", "1", "m"), lambda: cols.extract_timestamp_component(mixed, "t", "year", "y"), lambda: cols.to_timestamps(mixed, "n", "timestamp[s]", "%Y", "y"),
        lambda: cols.to_timestamps(mixed, "t", "int64", "%Y", "y"), lambda: cols.replace_nulls(mixed, "n", "x", "y"), lambda: cols.replace_nulls(mixed, "n", 1.5, "y"), lambda: cols.replace_nulls(mixed, "n", 1, "y", "int32"),
        lambda: cols.copy_if_else(mixed, "n", "x", "x", "y"), lambda: cols.copy_if_else(mixed, "b", "x", "n", "y"), lambda: cols.match(mixed, "none", "starts_with", "1", "m"),
    ):
        with pytest.raises(ValueError):  # noqa: PT011
            call()
    assert [r.y for r in cols.replace_nulls(mixed, "n", 7, "y").collect()] == [1, 2, 7]
    assert [r.y for r in cols.replace_nulls(mixed, "t", None, "y").collect()] == ["a", None, "c"]
    assert [r.y for r in cols.copy_if_else(mixed, "b", "n", F.lit(0).cast("long"), "y").collect()] == [1, 0, 0]
    assert [r.y for r in cols.match(mixed, "t", "ends_with", "c", "y").collect()] == [False, None, True]


def test_timestamp_types(spark):
    df = spark.createDataFrame([("2020-01-02 03:04:05.678901",)], "t string")
    got = [cols.to_timestamps(df, "t", k, "%Y-%m-%d %H:%M:%S.%f", "y").first().y.microsecond for k in ("timestamp[s]", "timestamp[ms]", "datetime64[us]")]
    assert got == [0, 678000, 678901]
    assert ts.unit_and_zone("timestamp[ms, tz=UTC]") == ("ms", True)
    assert cols.to_timestamps(df, "t", "timestamp[us]", "%Y", "y").schema["y"].dataType.simpleString() == "timestamp_ntz"


def test_fractions(mixed):
    row = mixed.select(lazy.millisecond(F.col("at")), lazy.microsecond(F.col("at")), lazy.nanosecond(F.col("at"))).first()
    assert tuple(row) == (678, 678901, 678901000)


def test_extremes_of_any_type(spark, mixed):
    day = datetime.date(2020, 1, 2)
    df = mixed.withColumn("d", F.lit(day))
    row = df.agg(*[f(F.col(k)).alias(f"{f.__name__}_{k}") for k in ("n", "t", "x", "b", "d", "at") for f in (lazy.least, lazy.greatest)]).first()
    assert (row.least_t, row.greatest_t, row.least_x, row.greatest_x, row.least_n, row.greatest_d) == ("a", "c", 1.0, 1.0, 1, day)
    assert [r[0] for r in mixed.select(s.binary(F.col("x"), 0.5, "max_element_wise")).collect()] == [1.0, 0.5, 0.5]
    floats = spark.createDataFrame([(math.nan, None)], "a float, b float")
    assert math.isnan(floats.select(s.binary(F.col("a"), F.col("b"), "max_element_wise")).first()[0])


def test_narrow_integers_wrap(spark):
    df = spark.createDataFrame([(v,) for v in (127, 128, -128, -129, 255, 256, (1 << 40) + 5)], "v long")
    assert [r[0] for r in df.select(s.binary(F.col("v"), 0, "add", "int8")).collect()] == [127, -128, -128, 127, -1, 0, 5]
    assert [r[0] for r in df.select(s.cast("v", "int16", "int64")).collect()] == [127, 128, -128, -129, 255, 256, 5]
    wide = spark.createDataFrame([((1 << 63) - 1,)], "v long")
    assert wide.select(s.binary(F.col("v"), 2, "add", "int8"), s.binary(F.col("v"), 3, "multiply", "int32")).first()[:] == (1, -3)


def test_products_in_parts(spark, monkeypatch):
    monkeypatch.setattr(agg, "FACTORS", 4)
    df = spark.range(0, 400, 1, 5).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 7 != 0, F.col("id") * 2 + 1).alias("v"), F.lit(None).cast("long").alias("none"))
    got = {r.k: (r.n, r.p, r.none) for r in agg.groupby_aggregation(df, ["k"], [("none", "product", "none"), (None, "count_all", "n"), ("v", "product", "p")]).collect()}
    for k in range(3):
        want = 1
        for i in range(k, 400, 3):
            want = want * (2 * i + 1) if i % 7 else want
        want &= (1 << 64) - 1
        assert got[k][1:] == (want - (1 << 64) if want >> 63 else want, None)
    assert agg.reduce(df.where("id < 0" if "id" in df.columns else "k < 0"), "v", "product", "int64").first()[0] is None
    assert agg.reduce(df.where("v < 10"), "v", "product", "int64", initial=2).first()[0] == 2 * 3 * 5 * 7 * 9


def test_median_sketch(spark):
    df = spark.range(10_001).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("x"))
    got = agg.groupby_aggregation(df, ["k"], [("x", ("approximate_median", {"accuracy": 1000}), "a"), ("x", "approximate_median", "b")]).first()
    assert abs(got.a - 5000) <= 10.001 and got.b == 5000


def test_places(spark):
    df = spark.range(0, 1000, 1, 7).toDF("a").repartition(5)
    out = sorted_slice(df, ["a"], 990)
    assert [r.a for r in out.collect()] == list(range(990, 1000))
    text = out._jdf.queryExecution().toString()
    assert "CollectLimit" not in text and "Offset" not in text
    assert sorted(r.a for r in tb.slice_rows(df, 400).collect()) != list(range(1000)) and tb.slice_rows(df, 400).count() == 600
    with pytest.raises(ValueError, match="rows"):
        tb.zip_frames(df, spark.range(10).toDF("b"))
    assert tb.zip_frames(df, spark.range(10).toDF("b"), shorter=True).count() == 10


def test_subtract_with_repeats(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,), (None,)], "x int"), spark.createDataFrame([(1,)], "x int")
    assert sorted((r.x for r in tb.subtract(a, b).collect()), key=str) == [2, None]


def test_lazy_sources(spark, tmp_path):
    import pandas as pd

    frame = lazy.from_frame(spark, pd.DataFrame({"a": [3, 1, 2]}))
    io.parquet_write(frame.df, tmp_path / "p")
    scan = lazy.scan_parquet(spark, f"{tmp_path}/p/*.parquet", ["a"], F.col("a") > 1)
    assert sorted(r.a for r in scan.df.collect()) == [2, 3] and "PushedFilters: [IsNotNull(a), GreaterThan(a,1)]" in scan.df._jdf.queryExecution().toString()
    assert frame.sort("a").tail(2).collect().to_pydict() == {"a": [2, 3]}


def test_arrays_and_offload(spark):
    import numpy as np

    df = spark.createDataFrame([(1, 2.0), (3, 4.0)], "a long, b double")
    fixed = io.to_array(df, writeable=False)
    with pytest.raises(ValueError, match="read-only"):
        fixed[0, 0] = 1
    out = np.zeros((2, 2))
    assert io.to_array(df, out=out) is out and out.tolist() == [[1, 2], [3, 4]]
    assert io.describe(df).startswith("[a: bigint, b: double]") and "(1, 2.0)" in io.describe(df)
    kept = io.offload(df, "memory")
    assert kept.storageLevel.useMemory and kept.count() == 2
    kept.unpersist()
    with pytest.raises(ValueError, match="target"):
        io.offload(df, "tape")
