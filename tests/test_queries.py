"""Every query of the core against its SQL, with several numbers of partitions."""

import duckdb
import pytest

from colframe import queries

TABLES = "region nation customer supplier part orders lineitem events".split()
NAMES = sorted(queries.oracle_sql())


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}") + 0.0
    return tuple(map(norm, v)) if isinstance(v, list) else v


def test_all_have_sql():
    assert set(queries.queries()) == set(NAMES)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, data, name):
    df = queries.queries()[name](spark, data)
    cols = sorted(df.columns)
    rel = con.sql(queries.oracle_sql()[name])
    at = [rel.columns.index(c) for c in cols]
    assert sorted(rel.columns) == cols
    want = sorted((tuple(norm(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("partitions", ["1", "17"])
def test_partitions_do_not_matter(spark, data, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    some = ("flagship_revenue", "join_full_nulleq", "distinct_all", "gb_null_keys", "topk", "contains_column")
    want = {n: sorted(map(tuple, queries.queries()[n](spark, data).collect()), key=repr) for n in some}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert {n: sorted(map(tuple, queries.queries()[n](spark, data).collect()), key=repr) for n in some} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
