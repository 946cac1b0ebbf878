"""Queries over all rows of their tables, at a scale at which a cut would show."""

import duckdb
import pytest
from pyspark.sql import functions as F

from colframe import queries

from .test_queries import TABLES, norm

DATA = "/root/testdata/sf0.01"
JOINS = [f"join_{kind}_{nulls}" for kind in ("inner", "left", "full", "semi", "anti") for nulls in ("nulleq", "nullneq")]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def both(spark, con, name):
    """Rows of the query, columns by name, after comparing them with its SQL."""
    df = queries.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    rel = con.sql(queries.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    want = sorted((tuple(map(norm, r)) for r in rel.select(*cols).fetchall()), key=repr)
    got = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
    assert sorted(got, key=repr) == want
    return [dict(zip(cols, r, strict=True)) for r in got]


@pytest.mark.parametrize("name", JOINS)
def test_joins(spark, con, name):
    rows = both(spark, con, name)
    if "_left_" in name or "_full_" in name:
        assert {r["c_custkey"] for r in rows} - {None} == {k for (k,) in con.sql("SELECT c_custkey FROM customer").fetchall()}
    if "_full_" in name:
        assert {r["s_suppkey"] for r in rows} - {None} == {k for (k,) in con.sql("SELECT s_suppkey FROM supplier").fetchall()}


@pytest.fixture(scope="module")
def thirty_times(tmp_path_factory):
    """Customers and suppliers thirty times, with keys of their own."""
    folder = tmp_path_factory.mktemp("thirty")
    for t, k in (("customer", "c_custkey"), ("supplier", "s_suppkey")):
        duckdb.sql(f"COPY (SELECT x.* REPLACE ({k} + i * 100000 AS {k}) FROM range(30) r(i), '{DATA}/{t}.parquet' x) TO '{folder}/{t}.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", [n for n in JOINS if "_semi_" not in n and "_anti_" not in n])
def test_frequent_keys_are_shared_among_tasks(spark, thirty_times, tmp_path, name):
    out = str(tmp_path / "out")
    queries.queries()[name](spark, thirty_times).withColumn("task", F.spark_partition_id()).write.parquet(out)
    c = duckdb.connect()
    for t in ("customer", "supplier"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{thirty_times}/{t}.parquet'")
    cols = "c_custkey, k, s_suppkey, j"
    total = f"SELECT count(*), sum(hash({cols})::HUGEINT), count(k), count(j), count(c_custkey), count(s_suppkey)"
    got = c.sql(f"{total} FROM '{out}/*.parquet'").fetchall()
    assert got == c.sql(f"{total} FROM ({queries.oracle_sql()[name]})").fetchall()
    most = c.sql(f"SELECT max(n) FROM (SELECT count(*) AS n FROM '{out}/*.parquet' GROUP BY task)").fetchall()[0][0]
    assert most < got[0][0] / 6


def test_semi_and_anti_are_all_rows(spark, con):
    n = con.sql("SELECT count(*) FROM customer").fetchall()[0][0]
    for nulls in ("nulleq", "nullneq"):
        assert sum(queries.queries()[f"join_{kind}_{nulls}"](spark, DATA).count() for kind in ("semi", "anti")) == n


def test_suffix_coalesce(spark, con):
    rows = both(spark, con, "join_suffix_coalesce")
    assert sum(r["v"] is not None for r in rows) == con.sql("SELECT count(*) FROM customer").fetchall()[0][0]
    assert sum(r["v_right"] is not None for r in rows) == con.sql("SELECT count(*) FROM supplier").fetchall()[0][0]


def test_product(spark, con):
    """Every row has a part in it: without the last one the product differs."""
    [row] = both(spark, con, "reduce_product")
    less = con.sql("SELECT round(product(1 + (l_discount - 0.05) / 1000), 9) FROM (SELECT *, row_number() OVER (ORDER BY abs(l_discount - 0.05) DESC) AS i FROM lineitem) WHERE i > 1").fetchall()[0][0]
    assert row["x"] not in (0.0, 1.0, norm(less))


def test_sort_desc_nulls_last(spark, con):
    """All rows, the nulls behind the others."""
    both(spark, con, "sort_desc_nulls_last")
    got = [tuple(r) for r in queries.queries()["sort_desc_nulls_last"](spark, DATA).select("p", "o", "n").collect()]
    assert len(got) == con.sql("SELECT count(*) FROM lineitem").fetchall()[0][0]
    assert got == sorted(got, key=lambda r: (r[0] is None, -(r[0] or 0), r[1], r[2])) and got[-1][0] is None


def test_sort_stable(spark, con):
    """All rows, ties in the order in which they are read."""
    rows = both(spark, con, "sort_stable")
    assert len(rows) == con.sql("SELECT count(*) FROM lineitem").fetchall()[0][0]
    got = [tuple(r) for r in queries.queries()["sort_stable"](spark, DATA).select("l_returnflag", "place").collect()]
    assert got == sorted(got)


def test_sort_stable_takes_no_flag_into_one_task(spark, con):
    df = queries.queries()["sort_stable"](spark, DATA)
    tasks = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == con.sql("SELECT count(*) FROM lineitem").fetchall()[0][0] and max(tasks) < sum(tasks) / 6
    assert df.schema["place"].dataType.simpleString() == "bigint"
