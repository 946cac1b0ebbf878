"""Element-wise functions on small frames: nulls, NaN, overflow, bad arguments."""

import math
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colframe.dtypes import to_spark
from colframe.functions import scalars as s
from colframe.functions import strings as st
from colframe.functions import timestamps as ts

NAN, INF = math.nan, math.inf


def values(df, x):
    return [r[0] for r in df.select(x.alias("x")).collect()]


def same(a, b):
    return len(a) == len(b) and all((x is None and y is None) or (x is not None and y is not None and (x == y or (isinstance(x, float) and math.isnan(x) and math.isnan(y)))) for x, y in zip(a, b))  # noqa: B905


@pytest.fixture(scope="module")
def nums(spark):
    rows = [(1, 2, 1.0, 2.0), (5, 0, 5.0, 0.0), (None, 3, None, 3.0), (-7, None, NAN, 1.0), ((1 << 63) - 1, 1, INF, INF), (-(1 << 63), -1, -1.0, -0.0)]
    return spark.createDataFrame(rows, "a long, b long, x double, y double").coalesce(1)


@pytest.fixture(scope="module")
def bools(spark):
    v = [True, False, None]
    return spark.createDataFrame([(a, b) for a in v for b in v], "a boolean, b boolean").coalesce(1)


def test_integers_wrap(nums):
    a, b = F.col("a"), F.col("b")
    assert values(nums, s.binary(a, b, "add", "int64")) == [3, 5, None, None, -(1 << 63), (1 << 63) - 1]
    assert values(nums, s.binary(a, b, "subtract", "int64")) == [-1, 5, None, None, (1 << 63) - 2, -(1 << 63) + 1]
    assert values(nums, s.binary(a, 2, "multiply", "int64")) == [2, 10, None, -14, -2, 0]
    assert values(nums, s.binary(a, b, "divide", "int64"))[:4] == [0, None, None, None]
    assert values(nums, s.cast("a", "int8", "int64")) == [1, 5, None, -7, -1, 0]


def test_ieee(nums):
    x, y = F.col("x"), F.col("y")
    assert same(values(nums, s.binary(x, y, "divide", "float64")), [0.5, INF, None, NAN, NAN, INF])
    assert same(values(nums, s.unary("x", "ln")), [0.0, math.log(5), None, NAN, INF, NAN])
    assert same(values(nums, s.unary("y", "ln"))[1:2], [-INF])
    assert same(values(nums, s.unary("x", "sqrt")), [1.0, math.sqrt(5), None, NAN, INF, NAN])
    assert same(values(nums, s.unary("x", "ceil", "float64")), [1.0, 5.0, None, NAN, INF, -1.0])


def test_comparisons_with_nan(nums):
    x = F.col("x")
    assert values(nums, s.binary(x, x, "equal", floats=True)) == [True, True, None, False, True, True]
    assert values(nums, s.binary(x, x, "not_equal", floats=True)) == [False, False, None, True, False, False]
    assert values(nums, s.binary(x, 1.0, "greater", floats=True)) == [False, True, None, False, True, False]


def test_strict_and_kleene(bools):
    a, b = F.col("a"), F.col("b")
    assert values(bools, s.binary(a, b, "and")) == [True, False, None, False, False, None, None, None, None]
    assert values(bools, s.binary(a, b, "or")) == [True, True, None, True, False, None, None, None, None]
    assert values(bools, s.binary(a, b, "and_kleene")) == [True, False, None, False, False, False, None, False, None]
    assert values(bools, s.binary(a, b, "or_kleene")) == [True, True, True, True, False, None, True, None, None]
    assert values(bools, s.unary("a", "invert"))[::3] == [False, True, None]


def test_tests_of_nulls_and_nan(nums):
    assert values(nums, s.unary("x", "is_nan")) == [False, False, None, True, False, False]
    assert values(nums, s.unary("x", "is_null")) == [False, False, True, False, False, False]
    assert same(values(nums, s.mask_nans("x")), [1.0, 5.0, None, None, INF, -1.0])


def test_between(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (None,)], "x long").coalesce(1)
    assert values(df, s.is_between("x", 1, 3, "none")) == [False, True, False, None]
    assert values(df, s.is_between("x", 1, 3, "left")) == [True, True, False, None]
    assert values(df, s.is_between("x", 1, 3, "right")) == [False, True, True, None]
    assert values(df, s.is_between("x", 1, 3)) == [True, True, True, None]
    with pytest.raises(ValueError, match="closed"):
        s.is_between("x", 1, 3, "some")


def test_rounding(spark):
    df = spark.createDataFrame([(x,) for x in (-1.5, -2.5, -3.5, 1.5, 1.1234, 123455.0, -1234.0)], "x double").coalesce(1)
    assert values(df, s.round_("x")) == [-2.0, -2.0, -4.0, 2.0, 1.0, 123455.0, -1234.0]
    assert values(df, s.round_("x", -1)) == [0.0, 0.0, 0.0, 0.0, 0.0, 123460.0, -1230.0]
    assert values(df, s.round_("x", 0, "half_away_from_zero")) == [-2.0, -3.0, -4.0, 2.0, 1.0, 123455.0, -1234.0]
    assert values(df, s.unary("x", "round")) == [-2.0, -2.0, -4.0, 2.0, 1.0, 123455.0, -1234.0]
    with pytest.raises(ValueError, match="mode"):
        s.round_("x", 0, "up")


def test_float_casts(spark):
    df = spark.createDataFrame([(x,) for x in (-3.7, 3.7, 300.0, NAN, None, -129.0)], "x double").coalesce(1)
    assert values(df, s.cast("x", "int32", "float64")) == [-3, 3, 300, 0, None, -129]
    assert values(df, s.cast("x", "int8", "float64")) == [-3, 3, 44, 0, None, 127]


def test_choices(spark):
    df = spark.createDataFrame([(True, 1, 10), (False, 2, 20), (None, 3, 30), (True, None, 40)], "c boolean, a long, b long").coalesce(1)
    assert values(df, s.if_else("c", F.col("a"), F.col("b"))) == [1, 20, 30, None]
    assert values(df, s.fill_null("a", 9)) == [1, 2, 3, 9]
    assert values(df, s.fill_null("a", None, "int64")) == [1, 2, 3, None]
    assert values(df, s.is_in("a", [2, 3, None])) == [False, True, True, None]
    assert values(df, s.is_in("a", [])) == [False, False, False, None]


def test_strings(spark):
    df = spark.createDataFrame([("hello",), ("olhel",), ("world",), ("wo.+d",), (None,)], "x string").coalesce(1)
    assert values(df, st.match("starts_with", "x", "hel")) == [True, False, False, False, None]
    assert values(df, st.match("ends_with", "x", "hel")) == [False, True, False, False, None]
    assert values(df, st.match("match_substring", "x", "o.+d")) == [False, False, False, True, None]
    assert values(df, st.match("match_substring_regex", "x", "o.+d")) == [False, False, True, True, None]
    assert values(df, st.match("starts_with", "x", "")) == [True] * 4 + [None]
    with pytest.raises(ValueError, match="unknown"):
        st.match("like", "x", "a")


def test_timestamps(spark):
    df = spark.createDataFrame([("2010-06-19T13:15",), ("2011-06-19T13:25",), ("bad",), (None,)], "x string").coalesce(1)
    assert [str(v) for v in values(df, ts.to_timestamps("x", "%Y-%m-%dT%H:%M"))] == ["2010-06-19 13:15:00", "2011-06-19 13:25:00", "None", "None"]
    two = spark.createDataFrame([("68",), ("69",)], "x string").coalesce(1)
    assert [v.year for v in values(two, ts.to_timestamps("x", "%y"))] == [2068, 1969]
    with pytest.raises(ValueError, match="%U"):
        ts.spark_pattern("%U")
    day = spark.createDataFrame([("2005-06-01 13:33:12.123263",), ("1969-12-31 23:59:59.000001",), (None,)], "x string").select(F.col("x").cast("timestamp_ntz").alias("x")).coalesce(1)
    got = {k: values(day, ts.extract("x", k)) for k in ts.COMPONENTS}
    assert [got[k][0] for k in ts.COMPONENTS] == [2005, 6, 1, 3, 13, 33, 12, 123, 263, 0]
    assert [got[k][1] for k in ("year", "day_of_week", "second", "millisecond", "microsecond")] == [1969, 3, 59, 0, 1]
    assert all(v[2] is None for v in got.values())


def test_types():
    for kind, want in ((pa.int8(), T.ByteType()), (pa.uint32(), T.LongType()), (pa.large_string(), T.StringType()), (pa.timestamp("ns"), T.TimestampNTZType()), (pa.timestamp("us", tz="UTC"), T.TimestampType()), (pa.duration("s"), T.DayTimeIntervalType()), (pa.date32(), T.DateType()), (pa.time64("us"), T.LongType()), ("float32", T.FloatType()), (int, T.LongType()), ("decimal(5,2)", T.DecimalType(5, 2))):
        assert to_spark(kind) == want
    with pytest.raises(TypeError):
        to_spark(pa.null())


def test_unknown_operations():
    with pytest.raises(ValueError, match="unknown"):
        s.binary(1, 2, "nope")
    with pytest.raises(ValueError, match="unknown"):
        s.unary(F.lit(1), "nope")


def test_rounded_as_duckdb(spark):
    import duckdb

    x = [59878.45, 98749.81, 0.0, -0.5, 2.5, -2.675, 1e300, 1e308, NAN, INF, -INF, None]
    x += [math.sqrt(i / 100) for i in range(90_068, 10_499_991, 101)]
    df = spark.createDataFrame([(v,) for v in x], "x double").coalesce(1)
    con = duckdb.connect()
    frame = pa.table({"x": pa.array(x, pa.float64(), from_pandas=False)})  # noqa: F841
    for digits in (9, 4, 2, 0, -2):
        assert same(values(df, s.rounded("x", digits)), [r[0] for r in con.sql(f"SELECT round(x, {digits}) FROM frame").fetchall()])


def test_computed_nans_have_plain_bits(spark):
    """The bits of NaN as DuckDB writes it, not those that the processor makes of 0 * inf or the root of -1."""
    df = spark.range(1000).select((F.col("id") * 0.0).alias("zero"), (-1.0 - F.col("id")).alias("below"))
    x = {"z": s.binary(F.col("zero"), F.col("zero"), "true_divide"), "q": s.unary("below", "sqrt"), "a": s.unary("below", "acosh"), "p": s.binary(F.col("below"), 0.5, "power")}
    out = df.select(*[v.alias(k) for k, v in x.items()]).toArrow()
    for k in x:
        assert {struct.pack(">d", v).hex() for v in out.column(k).to_numpy()} == {"7ff8000000000000"}
