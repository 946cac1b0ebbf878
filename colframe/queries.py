"""Queries over the test tables, one or more for each operator, each with the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as s
from .functions import strings as st
from .functions import timestamps as ts
from .operators import aggregate as agg
from .operators import columns as cols
from .operators import tables as tb
from .operators.join import join, join_on
from .operators.places import many_tasks, placed, scratch
from .operators.sort import sort, sorted_slice
from .plans import lazy
from .sources import io

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def named(name: str, sql: str, f: Callable[[SparkSession, str], DataFrame]) -> None:
    _QUERIES[name], _SQL[name] = f, sql


def read(spark: SparkSession, d: str, name: str, columns: list[str] | None = None) -> DataFrame:
    return io.parquet_read(spark, [f"{d}/{name}.parquet"], columns=columns)


def c(name):
    return F.col(name)

# derived columns with nulls and NaNs: the test tables have none


def QTY_NULL():
    return F.when(c("l_linenumber") % 3 != 0, c("l_quantity"))


QTY_NULL_SQL = "CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END"


def FLAG_A():
    return F.when(c("l_linenumber") % 4 != 0, c("l_quantity") > 25)


FLAG_A_SQL = "CASE WHEN l_linenumber % 4 <> 0 THEN l_quantity > 25 END"


def FLAG_B():
    return F.when(c("l_linenumber") % 3 != 0, c("l_discount") > 0.05)


FLAG_B_SQL = "CASE WHEN l_linenumber % 3 <> 0 THEN l_discount > 0.05 END"


def VAL_NAN():
    return F.when(c("l_linenumber") % 5 == 0, F.lit(float("nan"))).otherwise(QTY_NULL())


VAL_NAN_SQL = f"CASE WHEN l_linenumber % 5 = 0 THEN 'nan'::DOUBLE ELSE {QTY_NULL_SQL} END"


def NATION():
    return F.when(c("c_nationkey") % 7 != 0, c("c_nationkey"))


NATION_SQL = "CASE WHEN c_nationkey % 7 <> 0 THEN c_nationkey END"
ID, ID_SQL = ["l_orderkey", "l_linenumber"], "l_orderkey, l_linenumber"


def items(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem")


# ---- flagship


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
  round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def flagship_revenue(spark, d):
    df = tb.apply_boolean_mask(items(spark, d), c("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    df = tb.with_columns(df, {"revenue": s.binary(c("l_extendedprice"), 1 - c("l_discount"), "multiply")})
    out = agg.groupby_aggregation(df, ["l_returnflag", "l_linestatus"], [("l_quantity", "sum", "sum_qty"), ("revenue", "sum", "revenue"), ("l_discount", "mean", "avg_disc"), (None, "count_all", "n")])
    return sort(out, ["l_returnflag", "l_linestatus"]).select("l_returnflag", "l_linestatus", s.rounded("sum_qty", 2).alias("sum_qty"), s.rounded("revenue", 2).alias("revenue"), s.rounded("avg_disc", 6).alias("avg_disc"), "n")


# ---- sources and sinks


@query("SELECT o_totalprice, o_orderkey FROM orders")
def scan_project(spark, d):
    return read(spark, d, "orders", ["o_totalprice", "o_orderkey"])


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def scan_filter(spark, d):
    return tb.apply_boolean_mask(items(spark, d), (c("l_quantity") > 45) & (c("l_returnflag") == "R")).select("l_orderkey", "l_quantity")


@query("SELECT count(*) AS n FROM orders")
def scan_no_columns(spark, d):
    return read(spark, d, "orders", []).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def csv_roundtrip(spark, d):
    folder = scratch(spark, "csv")
    io.csv_write(read(spark, d, "supplier"), folder, delimiter="|")
    return io.csv_read(spark, folder + "/*.csv", dtypes=["int64", "string", "float64"], delimiter="|", usecols=["s_suppkey", "s_name", "s_acctbal"])


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def parquet_roundtrip(spark, d):
    folder = scratch(spark, "pq")
    io.parquet_write(read(spark, d, "nation"), folder)
    return io.parquet_read(spark, folder + "/*.parquet")


@query("SELECT [l_quantity, l_discount, coalesce(CASE WHEN l_tax > 0.04 THEN l_tax END, 0.5)] AS values FROM lineitem")
def parquet_array(spark, d):
    return items(spark, d).select("l_quantity", "l_discount", F.when(c("l_tax") > 0.04, c("l_tax")).alias("l_tax")).select(F.array(c("l_quantity"), c("l_discount"), s.fill_null("l_tax", 0.5)).alias("values"))


@query("SELECT [p_partkey::DOUBLE, p_size::DOUBLE, p_retailprice] AS values FROM part")
def parquet_array_cast(spark, d):
    return io.parquet_read_array(spark, [f"{d}/part.parquet"], columns=["p_partkey", "p_size", "p_retailprice"], type="float64")


@query("SELECT range::BIGINT AS value FROM range(-5, 995)")
def sequence(spark, d):
    return io.sequence(spark, 1000, -5)


# ---- projection, rows, metadata


@query("SELECT n_name, n_nationkey FROM nation")
def select_by_index(spark, d):
    return tb.select(read(spark, d, "nation"), [1, 0])


@query("SELECT n_nationkey * 2 AS n_nationkey, n_name, n_regionkey, n_regionkey + 1 AS next FROM nation")
def with_columns(spark, d):
    return tb.with_columns(read(spark, d, "nation"), {"n_nationkey": c("n_nationkey") * 2, "next": c("n_regionkey") + 1})


@query("SELECT n_nationkey AS a, n_name AS b, 7 AS c FROM nation")
def construct_table(spark, d):
    return tb.table(read(spark, d, "nation"), [c("n_nationkey"), c("n_name"), 7], ["a", "b", "c"])


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 30")
def slice_rows(spark, d):
    return tb.slice_rows(read(spark, d, "orders", ["o_orderkey"]), 30, 50, ["o_orderkey"])


@query("SELECT o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 8) ORDER BY o_orderkey LIMIT 6")
def slice_negative(spark, d):
    return tb.slice_rows(read(spark, d, "orders", ["o_orderkey"]), -8, -2, ["o_orderkey"])


@query(f"SELECT {ID_SQL} FROM lineitem WHERE {FLAG_A_SQL}")
def filter_null_mask(spark, d):
    return tb.apply_boolean_mask(items(spark, d), FLAG_A()).select(*ID)


@query("SELECT n_name, r_name FROM nation JOIN region ON n_nationkey = r_regionkey")
def zip_frames(spark, d):
    a, b = read(spark, d, "nation").select("n_nationkey", "n_name"), read(spark, d, "region").select("r_regionkey", "r_name")
    return tb.zip_frames(a.orderBy("n_nationkey").coalesce(1), b.orderBy("r_regionkey").coalesce(1), shorter=True).select("n_name", "r_name")


# ---- binary operations


def scalar_query(name: str, columns: Callable[[], dict], sql: dict, keys=ID, keys_sql: str = ID_SQL, table: str = "lineitem") -> None:
    named(name, f"SELECT {keys_sql}, {', '.join(f'{v} AS {k}' for k, v in sql.items())} FROM {table}", lambda spark, d: read(spark, d, table).select(*keys, *[v.alias(k) for k, v in columns().items()]))




def price():
    return c("l_extendedprice")


def qty():
    return c("l_quantity")


def disc():
    return c("l_discount")


scalar_query("bin_arith", lambda: {"a": s.binary(price(), qty(), "add", "float64"), "b": s.binary(price(), qty(), "subtract", "float64"), "m": s.binary(QTY_NULL(), 3, "multiply", "float64"), "i": s.binary(c("l_orderkey"), c("l_partkey"), "multiply", "int64"), "w": s.binary(c("l_linenumber"), 100, "multiply", "int8")},
             {"a": "l_extendedprice + l_quantity", "b": "l_extendedprice - l_quantity", "m": f"({QTY_NULL_SQL}) * 3", "i": "l_orderkey * l_partkey", "w": "((l_linenumber * 100 + 128) % 256 - 128)::TINYINT"})
scalar_query("bin_divide_ieee", lambda: {"q": s.binary(price(), c("l_linenumber") % 2, "divide", "float64"), "z": s.binary(c("l_linenumber") * 0.0, c("l_linenumber") % 2, "true_divide"), "i": s.binary(c("l_orderkey"), c("l_linenumber") - 1, "divide", "int64")},
             {"q": "CASE WHEN l_linenumber % 2 = 0 THEN 'inf'::DOUBLE ELSE l_extendedprice END", "z": "CASE WHEN l_linenumber % 2 = 0 THEN 'nan'::DOUBLE ELSE 0.0 END", "i": "CASE WHEN l_linenumber > 1 THEN l_orderkey // (l_linenumber - 1) END"})
scalar_query("bin_power_atan2_logb", lambda: {"p": s.rounded(s.binary(disc() + 1, c("l_linenumber"), "power"), 9), "t": s.rounded(s.binary(qty(), price(), "atan2"), 9), "l": s.rounded(s.binary(price(), 10.0, "logb"), 9), "f": s.binary(c("l_orderkey"), 7, "floor_divide", "int64"), "r": s.binary(c("l_orderkey"), 7, "mod", "int64")},
             {"p": "round(pow(l_discount + 1, l_linenumber), 9)", "t": "round(atan2(l_quantity, l_extendedprice), 9)", "l": "round(ln(l_extendedprice) / ln(10.0), 9)", "f": "l_orderkey // 7", "r": "l_orderkey % 7"})
scalar_query("bin_bitwise_shift", lambda: {"a": s.binary(c("l_orderkey"), c("l_partkey"), "bit_wise_and"), "o": s.binary(c("l_orderkey"), c("l_partkey"), "bit_wise_or"), "x": s.binary(c("l_orderkey"), c("l_partkey"), "bit_wise_xor"), "l": s.binary(c("l_orderkey"), c("l_linenumber"), "shift_left"), "r": s.binary(c("l_orderkey"), c("l_linenumber"), "shift_right")},
             {"a": "l_orderkey & l_partkey", "o": "l_orderkey | l_partkey", "x": "xor(l_orderkey, l_partkey)", "l": "l_orderkey << l_linenumber", "r": "l_orderkey >> l_linenumber"})
scalar_query("bin_compare", lambda: {k: s.binary(VAL_NAN(), 25.0, op, floats=True) for k, op in (("eq", "equal"), ("ne", "not_equal"), ("lt", "less"), ("le", "less_equal"), ("gt", "greater"), ("ge", "greater_equal"))},
             {k: f"CASE WHEN ({VAL_NAN_SQL}) IS NULL THEN NULL WHEN isnan({VAL_NAN_SQL}) THEN {'TRUE' if k == 'ne' else 'FALSE'} ELSE ({VAL_NAN_SQL}) {op} 25.0 END" for k, op in (("eq", "="), ("ne", "<>"), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">="))})
scalar_query("bool_strict", lambda: {"a": s.binary(FLAG_A(), FLAG_B(), "and"), "o": s.binary(FLAG_A(), FLAG_B(), "or"), "x": s.binary(FLAG_A(), FLAG_B(), "xor")},
             {k: f"CASE WHEN ({FLAG_A_SQL}) IS NOT NULL AND ({FLAG_B_SQL}) IS NOT NULL THEN ({FLAG_A_SQL}) {op} ({FLAG_B_SQL}) END" for k, op in (("a", "AND"), ("o", "OR"), ("x", "<>"))})
scalar_query("bool_kleene", lambda: {"a": s.binary(FLAG_A(), FLAG_B(), "and_kleene"), "o": s.binary(FLAG_A(), FLAG_B(), "or_kleene")}, {"a": f"({FLAG_A_SQL}) AND ({FLAG_B_SQL})", "o": f"({FLAG_A_SQL}) OR ({FLAG_B_SQL})"})
for _side, (_lo, _hi) in {"none": (">", "<"), "left": (">=", "<"), "right": (">", "<="), "both": (">=", "<=")}.items():
    scalar_query(f"between_{_side}", lambda side=_side: {"b": s.is_between(QTY_NULL(), 10.0, 30.0, side)}, {"b": f"({QTY_NULL_SQL}) {_lo} 10 AND ({QTY_NULL_SQL}) {_hi} 30"})

# ---- unary operations

_trig = ("sin", "cos", "tan", "asin", "acos", "atan")
scalar_query("unary_trig", lambda: {k: s.rounded(s.unary(disc(), k), 9) for k in _trig}, {k: f"round({k}(l_discount), 9)" for k in _trig})
_hyper = ("sinh", "cosh", "tanh", "asinh", "atanh")
scalar_query("unary_hyper", lambda: {k: s.rounded(s.unary(disc(), k), 9) for k in _hyper} | {"acosh": s.rounded(s.unary(qty(), "acosh"), 9)}, {k: f"round({k}(l_discount), 9)" for k in _hyper} | {"acosh": "round(acosh(l_quantity), 9)"})
scalar_query("unary_exp_ln_sqrt", lambda: {"e": s.rounded(s.unary(disc(), "exp"), 9), "l": s.rounded(s.unary(price(), "ln"), 9), "q": s.rounded(s.unary(price(), "sqrt"), 9), "z": s.unary(c("l_linenumber") - 1 - (c("l_linenumber") % 2) * 0, "ln").isNull(), "i": s.unary(F.when(c("l_linenumber") == 1, 0.0).otherwise(1.0), "ln"), "n": F.isnan(s.unary(-price(), "ln"))},
             {"e": "round(exp(l_discount), 9)", "l": "round(ln(l_extendedprice), 9)", "q": "round(sqrt(l_extendedprice), 9)", "z": "FALSE", "i": "CASE WHEN l_linenumber = 1 THEN '-inf'::DOUBLE ELSE 0.0 END", "n": "TRUE"})
scalar_query("unary_ceil_floor_abs_negate_round", lambda: {"c": s.unary(price(), "ceil", "float64"), "f": s.unary(-price(), "floor", "float64"), "a": s.unary(qty() - 25, "abs"), "n": s.unary(qty(), "negate"), "r": s.unary(price(), "round") + 0.0},
             {"c": "ceil(l_extendedprice)", "f": "floor(-l_extendedprice)", "a": "abs(l_quantity - 25)", "n": "-l_quantity", "r": "round_even(l_extendedprice, 0) + 0.0"})
scalar_query("unary_bitnot_invert", lambda: {"b": s.unary("l_orderkey", "bit_wise_not"), "i": s.unary(FLAG_A(), "invert")}, {"b": "~l_orderkey", "i": f"NOT ({FLAG_A_SQL})"})
scalar_query("null_tests", lambda: {"n": s.unary(QTY_NULL(), "is_null"), "v": s.unary(QTY_NULL(), "is_valid")}, {"n": f"({QTY_NULL_SQL}) IS NULL", "v": f"({QTY_NULL_SQL}) IS NOT NULL"})
scalar_query("is_nan", lambda: {"n": s.unary(VAL_NAN(), "is_nan")}, {"n": f"isnan({VAL_NAN_SQL})"})
scalar_query("cast_num", lambda: {"i": s.cast(price(), "int32", "float64"), "b": s.cast("l_orderkey", "int8", "int64"), "f": s.cast("l_orderkey", "float64", "int64"), "n": s.cast(QTY_NULL(), "int16", "float64"), "t": s.cast("l_orderkey", "string", "int64")},
             {"i": "trunc(l_extendedprice)::INT", "b": "((l_orderkey + 128) % 256 - 128)::TINYINT", "f": "l_orderkey::DOUBLE", "n": f"trunc({QTY_NULL_SQL})::SMALLINT", "t": "l_orderkey::VARCHAR"})
scalar_query("round_half_even", lambda: {"a": s.round_(qty() / 4, 0) + 0.0, "b": s.round_(price(), -2) + 0.0}, {"a": "round_even(l_quantity / 4, 0) + 0.0", "b": "round_even(l_extendedprice / 100, 0) * 100 + 0.0"})
scalar_query("round_half_away", lambda: {"a": s.round_(qty() / 4, 0, "half_away_from_zero"), "b": s.round_(-qty() / 2, 0, "half_away_from_zero")}, {"a": "round(l_quantity / 4, 0)", "b": "round(-l_quantity / 2, 0)"})
scalar_query("if_else", lambda: {"x": s.if_else(FLAG_A(), qty(), QTY_NULL()), "y": s.if_else(qty() > 10, "high", "low")}, {"x": f"CASE WHEN {FLAG_A_SQL} THEN l_quantity ELSE {QTY_NULL_SQL} END", "y": "CASE WHEN l_quantity > 10 THEN 'high' ELSE 'low' END"})
scalar_query("fill_null", lambda: {"x": s.fill_null(QTY_NULL(), -1.0), "y": s.fill_null(QTY_NULL(), None, "float64")}, {"x": f"coalesce({QTY_NULL_SQL}, -1)", "y": QTY_NULL_SQL})
scalar_query("mask_nans", lambda: {"x": s.mask_nans(VAL_NAN())}, {"x": f"CASE WHEN NOT isnan({VAL_NAN_SQL}) THEN ({VAL_NAN_SQL}) END"})
scalar_query("contains_literal", lambda: {"x": s.is_in(QTY_NULL(), [1.0, 2.0, None, 30.0])}, {"x": f"({QTY_NULL_SQL}) IN (1, 2, 30)"})


@query(f"""WITH h AS (SELECT CASE WHEN s_nationkey % 5 <> 0 THEN s_nationkey END AS k FROM supplier)
SELECT c_custkey, {NATION_SQL} AS k, CASE WHEN ({NATION_SQL}) IS NULL THEN NULL ELSE ({NATION_SQL}) IN (SELECT k FROM h WHERE k IS NOT NULL) END AS contained FROM customer""")
def contains_column(spark, d):
    hay = read(spark, d, "supplier").select(F.when(c("s_nationkey") % 5 != 0, c("s_nationkey")).alias("k"))
    return tb.contains(read(spark, d, "customer").select("c_custkey", NATION().alias("k")), "k", hay, "k")


# ---- strings and timestamps



def _name():
    return F.when(c("p_size") % 6 != 0, c("p_name"))


_NAME_SQL = "CASE WHEN p_size % 6 <> 0 THEN p_name END"
for _q, _kind, _pattern, _sql in (
    ("str_starts", "starts_with", "part 1", f"starts_with({_NAME_SQL}, 'part 1')"), ("str_ends", "ends_with", "7", f"ends_with({_NAME_SQL}, '7')"),
    ("str_contains", "match_substring", "1", f"contains({_NAME_SQL}, '1')"), ("str_regex", "match_substring_regex", "[aeiou].*[02468]$", f"regexp_matches({_NAME_SQL}, '[aeiou].*[02468]$')"),
):
    scalar_query(_q, lambda kind=_kind, pattern=_pattern: {"m": st.match(kind, _name(), pattern)}, {"m": _sql}, ["p_partkey"], "p_partkey", "part")
scalar_query("str_functions", lambda: {"u": st.apply("upper", _name()), "n": st.apply("length", _name()).cast("long"), "r": st.apply("replace", _name(), "a", "--"), "p": st.apply("slice", _name(), 1, 3)},
             {"u": f"upper({_NAME_SQL})", "n": f"length({_NAME_SQL})", "r": f"replace({_NAME_SQL}, 'a', '--')", "p": f"substr({_NAME_SQL}, 2, 3)"}, ["p_partkey"], "p_partkey", "part")
scalar_query("to_timestamps", lambda: {"t": ts.to_timestamps(F.when(c("event_id") % 5 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm")), "%Y-%m-%dT%H:%M"), "y": ts.to_timestamps(F.concat(F.lit("01/02/"), F.lpad((c("event_id") % 100).cast("string"), 2, "0")), "%d/%m/%y")},
             {"t": "CASE WHEN event_id % 5 <> 0 THEN date_trunc('minute', ts) END", "y": "make_timestamp(CASE WHEN event_id % 100 >= 69 THEN 1900 ELSE 2000 END + event_id % 100, 2, 1, 0, 0, 0)"}, ["event_id"], "event_id", "events")


def _t():
    return F.when(c("event_id") % 11 != 0, c("ts"))


_TS_SQL = "CASE WHEN event_id % 11 <> 0 THEN ts END"
scalar_query("ts_components", lambda: {k: ts.extract(_t(), k) for k in ts.COMPONENTS},
             {k: f"{f}({_TS_SQL})" for k, f in (("year", "year"), ("month", "month"), ("day", "day"), ("day_of_week", "isodow"), ("hour", "hour"), ("minute", "minute"), ("second", "second"))}
             | {"millisecond": f"millisecond({_TS_SQL}) % 1000", "microsecond": f"microsecond({_TS_SQL}) % 1000", "nanosecond": f"CASE WHEN ({_TS_SQL}) IS NOT NULL THEN 0::BIGINT END"}, ["event_id"], "event_id", "events")

# ---- grouped aggregation


def grouped(name: str, requests: list, sql: dict, keys: list[str] | None = None) -> None:
    keys = keys or ["l_returnflag", "l_linenumber"]

    def run(spark, d):
        df = items(spark, d).withColumns({"q": QTY_NULL(), "v": VAL_NAN(), "k": F.when(c("l_linenumber") % 3 != 0, c("l_linenumber"))})
        out = agg.groupby_aggregation(df, keys, requests)
        return out.select(*[s.rounded(x, 4).alias(x) if t == "double" and x not in keys else c(x) for x, t in out.dtypes])

    body = ", ".join(f"{v} AS {k}" for k, v in sql.items())
    k_sql = ", ".join("CASE WHEN l_linenumber % 3 <> 0 THEN l_linenumber END AS k" if k == "k" else k for k in keys)
    named(name, f"SELECT {k_sql}, {body} FROM lineitem GROUP BY ALL", run)


q_ = QTY_NULL_SQL
grouped("gb_sum_min_max", [("q", "sum", "a"), ("q", "min", "b"), ("q", "max", "c"), ("l_partkey", "sum", "e")], {"a": f"round(sum({q_}), 4)", "b": f"round(min({q_}), 4)", "c": f"round(max({q_}), 4)", "e": "sum(l_partkey)::BIGINT"})
grouped("gb_mean_count_countall", [("q", "mean", "a"), ("q", "count", "b"), (None, "count_all", "e"), ("q", ("count", {"mode": "all"}), "f")], {"a": f"round(avg({q_}), 4)", "b": f"count({q_})", "e": "count(*)", "f": "count(*)"})
grouped("gb_var_std_pop", [("q", "variance", "a"), ("q", "stddev", "b")], {"a": f"round(var_pop({q_}), 4)", "b": f"round(stddev_pop({q_}), 4)"})
grouped("gb_median", [("q", "approximate_median", "a")], {"a": f"round(median({q_}), 4)"})
grouped("gb_count_distinct_valid", [("q", "count_distinct", "a")], {"a": f"count(DISTINCT {q_})"}, ["l_returnflag"])
grouped("gb_count_distinct_all", [("q", ("count_distinct", {"mode": "all"}), "a")], {"a": f"count(DISTINCT {q_}) + max((({q_}) IS NULL)::BIGINT)"}, ["l_returnflag"])
grouped("gb_null_keys", [("l_quantity", "sum", "a"), (None, "count_all", "n")], {"a": "round(sum(l_quantity), 4)", "n": "count(*)"}, ["k"])


@query("SELECT l_orderkey, product(l_linenumber)::BIGINT AS p, round(product(l_discount + 1), 6) AS f FROM lineitem GROUP BY l_orderkey")
def gb_product(spark, d):
    df = items(spark, d).select("l_orderkey", c("l_linenumber").cast("long").alias("n"), (disc() + 1).alias("x"))
    return agg.groupby_aggregation(df, ["l_orderkey"], [("n", "product", "p"), ("x", "product", "f")]).select("l_orderkey", "p", s.rounded("f", 6).alias("f"))


@query(f"""SELECT l_returnflag, round(coalesce(sum(CASE WHEN l_linenumber > 100 THEN l_quantity END), 0), 4) AS zero, round(sum(l_quantity * 2) / count(*) + 1, 4) AS mixed,
  max(CASE WHEN NOT isnan({VAL_NAN_SQL}) THEN ({VAL_NAN_SQL}) END) AS hi, min(CASE WHEN NOT isnan({VAL_NAN_SQL}) THEN ({VAL_NAN_SQL}) END) AS lo,
  count(DISTINCT {QTY_NULL_SQL}) + max((({QTY_NULL_SQL}) IS NULL)::BIGINT) AS u FROM lineitem GROUP BY l_returnflag""")
def gb_post_expr(spark, d):
    frame = lazy.LazyFrame(items(spark, d)).group_by("l_returnflag")
    out = frame.agg(zero=lazy.total(F.when(c("l_linenumber") > 100, qty())), mixed=F.sum(qty() * 2) / lazy.length() + 1, hi=lazy.greatest(VAL_NAN()), lo=lazy.least(VAL_NAN()), u=lazy.n_unique(QTY_NULL()))
    return out.df.select("l_returnflag", s.rounded("zero", 4).alias("zero"), s.rounded("mixed", 4).alias("mixed"), "hi", "lo", "u")


# ---- reductions


def reduced(name: str, op: str, kind: str, sql: str, column=QTY_NULL, initial=None, digits: int | None = 4) -> None:
    def run(spark, d):
        out = agg.reduce(items(spark, d).select(column().alias("x")), "x", op, kind, initial)
        return out.select(s.rounded("x", digits).alias("x")) if digits is not None and kind == "float64" else out

    named(name, f"SELECT {f'round({sql}, {digits})' if digits is not None and kind == 'float64' else sql} AS x FROM lineitem", run)


reduced("reduce_sum", "sum", "float64", f"sum({q_})", digits=2)
reduced("reduce_mean", "mean", "float64", f"avg({q_})")
reduced("reduce_min", "min", "float64", f"min(CASE WHEN NOT isnan({VAL_NAN_SQL}) THEN ({VAL_NAN_SQL}) END)", VAL_NAN)
reduced("reduce_max", "max", "float64", f"max(CASE WHEN NOT isnan({VAL_NAN_SQL}) THEN ({VAL_NAN_SQL}) END)", VAL_NAN)
reduced("reduce_product", "product", "float64", "product(1 + (l_discount - 0.05) / 1000)", lambda: 1 + (disc() - 0.05) / 1000, digits=9)
reduced("reduce_count_valid", "count_valid", "int64", f"count({q_})")
reduced("reduce_any", "any", "bool", f"bool_or({FLAG_A_SQL})", FLAG_A)
reduced("reduce_all", "all", "bool", f"bool_and({FLAG_A_SQL})", FLAG_A)
reduced("reduce_initial", "sum", "float64", f"sum({q_}) + 2.5", initial=2.5, digits=2)
reduced("reduce_min_initial", "min", "float64", f"least(min({q_}), -1.0)", initial=-1.0)
reduced("reduce_empty_null", "sum", "float64", "sum(CASE WHEN l_orderkey < 0 THEN l_quantity END)", lambda: F.when(c("l_orderkey") < 0, qty()))


@query("SELECT (SELECT l_quantity FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 1) AS f, (SELECT l_quantity FROM lineitem ORDER BY l_orderkey DESC, l_linenumber DESC LIMIT 1) AS l, (SELECT count(*) FROM lineitem) AS n")
def reduce_first_last_len(spark, d):
    order = F.struct("l_orderkey", "l_linenumber")
    return items(spark, d).agg(lazy.first(qty(), order).alias("f"), lazy.last(qty(), order).alias("l"), lazy.length().alias("n"))


# ---- joins


def customers_suppliers(spark, d):
    a = read(spark, d, "customer").select("c_custkey", NATION().alias("k"), "c_acctbal")
    b = read(spark, d, "supplier").select("s_suppkey", F.when(c("s_nationkey") % 7 != 0, c("s_nationkey") + 3).alias("j"), "s_acctbal")
    return a, b


_JOIN_SQL = f"""WITH a AS (SELECT c_custkey, {NATION_SQL} AS k FROM customer),
b AS (SELECT s_suppkey, CASE WHEN s_nationkey % 7 <> 0 THEN s_nationkey + 3 END AS j FROM supplier) """
for _type in ("inner", "left", "full", "semi", "anti"):
    for _equal in (True, False):
        _on = "a.k IS NOT DISTINCT FROM b.j" if _equal else "a.k = b.j"
        _sql = _JOIN_SQL + (f"SELECT c_custkey, k FROM a WHERE {'NOT ' * (_type == 'anti')}EXISTS (SELECT 1 FROM b WHERE {_on})" if _type in ("semi", "anti") else f"SELECT c_custkey, k, s_suppkey, j FROM a {_type} JOIN b ON {_on}")

        def _run(spark, d, kind=_type, equal=_equal):
            a, b = customers_suppliers(spark, d)
            names = ["c_custkey", "k"] if kind in ("semi", "anti") else ["c_custkey", "k", "s_suppkey", "j"]
            return join(a, b, lhs_keys=["k"], rhs_keys=["j"], join_type=kind, nulls_equal=equal, keys_repeat=True, lhs_out_columns=["c_custkey", "k"]).select(*names)

        named(f"join_{_type}_{'nulleq' if _equal else 'nullneq'}", _sql, _run)


@query("SELECT l_orderkey, o_custkey, l_quantity, o_totalprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def join_large(spark, d):
    return join(items(spark, d), read(spark, d, "orders"), lhs_keys=["l_orderkey"], rhs_keys=["o_orderkey"], nulls_equal=False, lhs_out_columns=["l_orderkey", "l_quantity"], rhs_out_columns=["o_custkey", "o_totalprice"])


@query("SELECT a.l_orderkey, a.l_linenumber, b.l_tax FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber")
def join_multi_key(spark, d):
    return join(items(spark, d), items(spark, d), lhs_keys=ID, rhs_keys=ID, lhs_out_columns=ID, rhs_out_columns=["l_tax"])


@query("SELECT s_name, n_name FROM supplier LEFT JOIN nation ON s_nationkey IS NOT DISTINCT FROM n_nationkey")
def join_broadcast_right(spark, d):
    return join(read(spark, d, "supplier"), read(spark, d, "nation"), lhs_keys=["s_nationkey"], rhs_keys=["n_nationkey"], join_type="LEFT", broadcast="RIGHT", lhs_out_columns=["s_name"], rhs_out_columns=["n_name"])


@query("SELECT s_name, n_name FROM nation JOIN supplier ON s_nationkey IS NOT DISTINCT FROM n_nationkey")
def join_broadcast_left(spark, d):
    return join(read(spark, d, "nation"), read(spark, d, "supplier"), lhs_keys=["n_nationkey"], rhs_keys=["s_nationkey"], broadcast="LEFT", lhs_out_columns=["n_name"], rhs_out_columns=["s_name"])


@query("""WITH a AS (SELECT c_custkey AS k, c_name AS v FROM customer), b AS (SELECT s_suppkey + 5 AS k, s_name AS v FROM supplier)
SELECT coalesce(a.k, b.k) AS k, a.v AS v, b.v AS v_right FROM a FULL JOIN b ON a.k = b.k""")
def join_suffix_coalesce(spark, d):
    a = read(spark, d, "customer").select(c("c_custkey").alias("k"), c("c_name").alias("v"))
    return join_on(a, read(spark, d, "supplier").select((c("s_suppkey") + 5).alias("k"), c("s_name").alias("v")), left_on=["k"], right_on=["k"], how="full")


# ---- sort and limits

def _sort_columns():
    return [F.when(c("l_linenumber") % 3 != 0, c("l_partkey")).alias("p"), c("l_orderkey").alias("o"), c("l_linenumber").alias("n")]


_SORT = "SELECT CASE WHEN l_linenumber % 3 <> 0 THEN l_partkey END AS p, l_orderkey AS o, l_linenumber AS n FROM lineitem"


def sorted_query(name: str, sql: str, **options) -> None:
    named(name, f"{_SORT} ORDER BY {sql}", lambda spark, d: sort(items(spark, d).select(*_sort_columns()), ["p", "o", "n"], **options))


sorted_query("sort_multi_nulls_first", "p NULLS FIRST, o, n", nulls_at_end=False)
sorted_query("sort_multi_nulls_last", "p NULLS LAST, o DESC, n", sort_ascending=[True, False, True])
sorted_query("sort_desc_nulls_last", "p DESC NULLS LAST, o, n", sort_ascending=[False, True, True])
sorted_query("topk", "p NULLS FIRST, o, n LIMIT 50", nulls_at_end=False, limit=50)
named("tail", f"SELECT * FROM ({_SORT} ORDER BY p DESC NULLS FIRST, o DESC, n DESC LIMIT 50)", lambda spark, d: sort(items(spark, d).select(*_sort_columns()), ["p", "o", "n"], limit=-50))
named("sort_slice", f"{_SORT} ORDER BY p NULLS LAST, o, n LIMIT 20 OFFSET 100", lambda spark, d: sorted_slice(items(spark, d).select(*_sort_columns()), ["p", "o", "n"], 100, 20))
named("sort_slice_tail", f"SELECT * FROM (SELECT * FROM ({_SORT} ORDER BY p DESC NULLS FIRST, o DESC, n DESC LIMIT 30) ORDER BY p NULLS LAST, o, n LIMIT 10)", lambda spark, d: sorted_slice(items(spark, d).select(*_sort_columns()), ["p", "o", "n"], -30, 10))
@query("""SELECT l_returnflag, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY r) AS place
FROM (SELECT *, row_number() OVER () AS r FROM lineitem)""")
def sort_stable(spark, d):
    tasks = many_tasks(spark)
    rows, _ = placed(sort(items(spark, d).select("l_returnflag", "l_orderkey", "l_linenumber"), ["l_returnflag"], stable=True, tasks=tasks), "at")
    # a window over each flag would take all rows of a flag into one task
    first = F.broadcast(rows.groupBy(c("l_returnflag").alias("flag")).agg(F.min("at").alias("first")))
    rows = rows.join(first, c("l_returnflag").eqNullSafe(c("flag")))
    rows = rows.select("l_returnflag", "l_orderkey", "l_linenumber", (c("at") - c("first") + 1).alias("place"))
    return sort(rows, ["l_returnflag", "place"], tasks=tasks)


# ---- sets


@query("SELECT c_nationkey AS k, c_acctbal AS v FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier")
def concat(spark, d):
    return tb.concatenate([read(spark, d, "customer").select(c("c_nationkey").alias("k"), c("c_acctbal").alias("v")), read(spark, d, "supplier").select(c("s_nationkey").alias("k"), c("s_acctbal").alias("v"))])


@query("SELECT DISTINCT l_returnflag, l_linestatus, CASE WHEN l_linenumber % 3 <> 0 THEN l_linenumber END AS k FROM lineitem")
def distinct_all(spark, d):
    return tb.distinct(items(spark, d).select("l_returnflag", "l_linestatus", F.when(c("l_linenumber") % 3 != 0, c("l_linenumber")).alias("k")))


@query("SELECT DISTINCT l_partkey % 50 AS k, l_partkey % 50 * 2 AS v FROM lineitem")
def distinct_keys(spark, d):
    return tb.distinct(items(spark, d).select((c("l_partkey") % 50).alias("k"), (c("l_partkey") % 50 * 2).alias("v")), ["k"])


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark, d):
    return tb.intersect(read(spark, d, "customer").select(c("c_nationkey").alias("k")), read(spark, d, "supplier").select(c("s_nationkey").alias("k")))


@query("SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey % 5 FROM supplier")
def set_subtract(spark, d):
    """Keys that repeat on both sides."""
    return tb.subtract(read(spark, d, "customer").select(c("c_nationkey").alias("k")), read(spark, d, "supplier").select((c("s_nationkey") % 5).alias("k")))


# ---- the lazy front end


@query("""SELECT n_name, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_totalprice > 1000 GROUP BY n_name""")
def lazy_pipeline(spark, d):
    frame = lazy.LazyFrame(read(spark, d, "customer")).join(lazy.LazyFrame(read(spark, d, "orders")).filter(c("o_totalprice") > 1000), ["c_custkey"], ["o_custkey"])
    frame = frame.join(lazy.LazyFrame(read(spark, d, "nation")), ["c_nationkey"], ["n_nationkey"])
    return frame.group_by("n_name").agg(total=s.rounded(lazy.total(c("o_totalprice")), 2), n=lazy.length()).sort("n_name").df


# ---- columns with their types checked

_TS_TEXT = "CASE WHEN event_id % 5 <> 0 THEN date_trunc('second', ts) END"


@query(f"SELECT p_partkey, starts_with({_NAME_SQL}, 'part 2') AS m FROM part")
def match_checked(spark, d):
    return cols.match(read(spark, d, "part").select("p_partkey", _name().alias("name")), "name", "starts_with", "part 2", "m").select("p_partkey", "m")


@query(f"SELECT event_id, {_TS_TEXT} AS u, date_trunc('second', {_TS_TEXT}) AS s FROM events")
def to_timestamps_typed(spark, d):
    df = read(spark, d, "events").select("event_id", F.when(c("event_id") % 5 != 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("x"))
    df = df.withColumn("y", F.concat("x", F.lit(".250000")))
    df = cols.to_timestamps(df, "x", "timestamp[us]", "%Y-%m-%d %H:%M:%S", "u")
    return cols.to_timestamps(df, "y", "timestamp[s]", "%Y-%m-%d %H:%M:%S.%f", "s").select("event_id", "u", "s")


@query(f"SELECT event_id, hour({_TS_SQL}) AS h FROM events")
def extract_checked(spark, d):
    return cols.extract_timestamp_component(read(spark, d, "events").select("event_id", _t().alias("t")), "t", "hour", "h").select("event_id", "h")


@query(f"SELECT {ID_SQL}, coalesce({QTY_NULL_SQL}, -1) AS x, CASE WHEN {FLAG_A_SQL} THEN l_quantity ELSE l_tax END AS y FROM lineitem")
def replace_and_choose_checked(spark, d):
    df = cols.replace_nulls(items(spark, d).withColumns({"q": QTY_NULL(), "f": FLAG_A()}), "q", -1.0, "x")
    return cols.copy_if_else(df, "f", "l_quantity", "l_tax", "y").select(*ID, "x", "y")


_V = VAL_NAN_SQL
scalar_query("bin_element_wise", lambda: {"hi": s.binary(VAL_NAN(), 25.0, "max_element_wise"), "lo": s.binary(VAL_NAN(), 25.0, "min_element_wise"), "s": s.binary(c("l_returnflag"), "B", "max_element_wise")},
             {"hi": f"CASE WHEN ({_V}) > 25 AND NOT isnan({_V}) THEN ({_V}) ELSE 25 END", "lo": f"CASE WHEN ({_V}) < 25 THEN ({_V}) ELSE 25 END", "s": "greatest(l_returnflag, 'B')"})


@query(f"SELECT l_returnflag, bool_or({FLAG_A_SQL}) AS a, bool_and({FLAG_A_SQL}) AS b, median(l_linenumber)::DOUBLE AS m FROM lineitem GROUP BY l_returnflag")
def gb_any_all_median(spark, d):
    df = items(spark, d).select("l_returnflag", FLAG_A().alias("f"), "l_linenumber")
    return agg.groupby_aggregation(df, ["l_returnflag"], [("f", "any", "a"), ("f", "all", "b"), ("l_linenumber", "median", "m")])


@query(f"SELECT * FROM (SELECT {ID_SQL}, {_V} AS v, row_number() OVER (ORDER BY {_V} NULLS LAST, {ID_SQL}) - 1 AS place FROM lineitem)")
def sort_nan(spark, d):
    """All rows with their places: NaN behind all numbers, null behind NaN."""
    return placed(sort(items(spark, d).select(*ID, VAL_NAN().alias("v")), ["v", *ID]), "place")[0]


@query(f"{_SORT} ORDER BY p NULLS LAST, o, n OFFSET 100")
def sort_slice_open(spark, d):
    return sorted_slice(items(spark, d).select(*_sort_columns()), ["p", "o", "n"], 100)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 30")
def slice_open(spark, d):
    return tb.slice_rows(read(spark, d, "orders", ["o_orderkey"]), 30, None, ["o_orderkey"])


# ---- more of the lazy front end


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_discount < 0.02")
def lazy_scan_parquet(spark, d):
    return lazy.scan_parquet(spark, [f"{d}/lineitem.parquet"], ["l_orderkey", "l_quantity"], c("l_discount") < 0.02).df


@query("SELECT n_nationkey, n_name FROM nation")
def lazy_scan_csv(spark, d):
    folder = scratch(spark, "csv")
    io.csv_write(read(spark, d, "nation", ["n_nationkey", "n_name"]), folder)
    return lazy.scan_csv(spark, folder + "/*.csv", ["int64", "string"]).df


@query("SELECT r_regionkey, r_name FROM region")
def lazy_from_frame(spark, d):
    return lazy.from_frame(spark, read(spark, d, "region", ["r_regionkey", "r_name"]).toArrow()).df


@query(f"SELECT event_id, (millisecond({_TS_SQL}) % 1000)::INT AS ms, (microsecond({_TS_SQL}) % 1000000)::INT AS us, (microsecond({_TS_SQL}) % 1000000 * 1000)::INT AS ns FROM events")
def lazy_dt_fractions(spark, d):
    return read(spark, d, "events").select("event_id", lazy.millisecond(_t()).alias("ms"), lazy.microsecond(_t()).alias("us"), lazy.nanosecond(_t()).alias("ns"))


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 40")
def lazy_slice(spark, d):
    return lazy.LazyFrame(read(spark, d, "orders", ["o_orderkey", "o_custkey"])).sort("o_orderkey").slice(40, 25).df


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def lazy_unique_cache(spark, d):
    return lazy.LazyFrame(items(spark, d).select("l_returnflag", "l_linestatus")).unique().cache().df


@query("SELECT max(p_name) AS hi, min(p_name) AS lo, min(p_size) AS size, sum(CASE WHEN p_size > 10 THEN p_retailprice END)::DECIMAL(20, 2)::DOUBLE AS some, count(DISTINCT p_size) AS sizes FROM part")
def lazy_extremes(spark, d):
    """Extremes of strings and whole numbers, an aggregate of some rows, and distinct values of a whole frame."""
    return read(spark, d, "part").agg(lazy.greatest(c("p_name")).alias("hi"), lazy.least(c("p_name")).alias("lo"), lazy.least(c("p_size")).alias("size"), s.rounded(F.sum(lazy.only(c("p_retailprice"), c("p_size") > 10)), 2).alias("some"), lazy.n_unique(c("p_size")).alias("sizes"))


@query("SELECT s_suppkey, s_name, n_name FROM nation RIGHT JOIN supplier ON n_nationkey = s_nationkey + 20")
def lazy_join_right(spark, d):
    n, s_ = read(spark, d, "nation", ["n_nationkey", "n_name"]), read(spark, d, "supplier").select((c("s_nationkey") + 20).alias("k"), "s_suppkey", "s_name")
    return lazy.LazyFrame(n).join(lazy.LazyFrame(s_), ["n_nationkey"], ["k"], "right").df.select("s_suppkey", "s_name", "n_name")


@query("SELECT n_name, r_name FROM nation CROSS JOIN region")
def join_cross(spark, d):
    return join_on(read(spark, d, "nation", ["n_name"]), read(spark, d, "region", ["r_name"]), left_on=[], right_on=[], how="cross")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
