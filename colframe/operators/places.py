"""Rows by their exact places, without passing them all through one task."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``. Where that is unset, a temporary one if all tasks run on this machine; on
    a cluster, whose executors wouldn't see it, an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="colframe-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def many_tasks(spark: SparkSession) -> int:
    """Tasks for a step whose size isn't known, or isn't that of its input."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)


def placed(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``df`` with the place of each row, from 0, in the order in which its rows are read, and the number of rows.

    The rows are written once with numbers of their own, as a second evaluation may read them in another order. A count of each
    partition then turns numbers into places; a row for each partition is broadcast."""
    spark, folder = df.sparkSession, scratch(df.sparkSession, "places")
    df.withColumn(name, F.monotonically_increasing_id()).write.parquet(folder)
    rows = spark.read.schema(df.schema.add(name, "long") if name not in df.columns else df.schema).parquet(folder)
    part = F.shiftright(F.col(name), 33)
    sizes = rows.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"), "__n")
    before = spark.createDataFrame(before.toArrow())  # a row for each partition
    number = before.agg(F.sum("__n")).first()[0] or 0
    out = rows.withColumn("__part", part).join(F.broadcast(before.drop("__n")), "__part")
    return out.withColumn(name, F.col("__before") + F.col(name).bitwiseAND(F.lit((1 << 33) - 1))).drop("__part", "__before"), number


def rows_from(df: DataFrame, start: int, stop: int | None = None) -> DataFrame:
    """The rows of places ``start`` to ``stop``, in their order; each task keeps those of its own rows."""
    name = "__place"
    while name in df.columns:
        name += "_"
    rows, _ = placed(df, name)
    rows = rows.where(F.col(name) >= start)
    rows = rows if stop is None else rows.where(F.col(name) < stop)
    return rows.orderBy(name).drop(name)
