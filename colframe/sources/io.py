"""Reading and writing Parquet and CSV, Arrow and NumPy data, and sequences."""

from __future__ import annotations

import csv
from collections.abc import Iterable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dtypes import is_float, is_integer, to_spark


def _paths(spark: SparkSession, files: Any) -> list[str]:
    """A glob, a path, or many paths, in order, as Hadoop knows them; ValueError if there is none."""
    if isinstance(files, (str, Path)):
        pattern = spark._jvm.org.apache.hadoop.fs.Path(str(Path(files).expanduser()) if str(files).startswith("~") else str(files))
        found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
        out = sorted(str(x.getPath()) for x in found) if found else []
    else:
        out = [str(f) for f in files]
    if not out:
        raise ValueError(f"no files match {files!r}")
    return out


def parquet_read(spark: SparkSession, files: str | Path | Iterable, *, columns: list[str] | None = None, ignore_row_groups: bool | None = None) -> DataFrame:
    """Parquet files with the schema of the first; ``columns`` chooses and orders columns, and may be empty.
    ``ignore_row_groups`` is accepted and changes nothing: Spark splits files by bytes."""
    df = spark.read.parquet(*_paths(spark, files))
    if columns is None:
        return df
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"no column {missing[0]!r}")
    return df.select(*[F.col(f"`{c}`") for c in columns])


def parquet_read_array(spark: SparkSession, files: Any, *, columns: list[str] | None = None, null_value: Any = None, type: Any = None) -> DataFrame:  # noqa: A002
    """One column ``values``: an array of each row's numbers. Columns must have one numeric type, or are cast to ``type``.
    Nulls become ``null_value`` if that is given, which must be of that type."""
    df = parquet_read(spark, files, columns=columns)
    kinds = {f.dataType for f in df.schema}
    if type is None and len(kinds) != 1:
        raise ValueError("columns of different types need a type to be cast to")
    kind = to_spark(type) if type is not None else kinds.pop()
    if not (is_integer(kind) or is_float(kind) or isinstance(kind, T.BooleanType)):
        raise ValueError("only numbers make an array")
    if null_value is not None and isinstance(null_value, float) and not is_float(kind):
        raise ValueError("the null value must have the array's type")
    cells = [F.col(f"`{c}`").cast(kind) for c in df.columns]
    return df.select(F.array(*[F.coalesce(c, F.lit(null_value).cast(kind)) if null_value is not None else c for c in cells]).alias("values"))


def csv_read(spark: SparkSession, files: Any, *, dtypes: list, na_filter: bool = True, delimiter: str = ",", usecols: list | None = None, names: list[str] | None = None) -> DataFrame:
    """CSV files. ``dtypes`` are those of the file's columns in order, or of ``usecols``.

    Columns are used by names of the header, or, in files without one, by indices that ``names`` belong to. They come
    back in the order of the file. Empty and missing fields are null; without ``na_filter`` empty strings stay."""
    if len(delimiter) != 1:
        raise ValueError("a delimiter is one character")
    paths = _paths(spark, files)
    kinds = [to_spark(d) for d in dtypes]
    by_index = usecols is not None and len(usecols) > 0 and all(isinstance(c, int) for c in usecols)
    if by_index != (names is not None):
        raise ValueError("names and columns by index go together")
    first = spark.read.text(paths[0]).limit(1).collect()
    head = next(csv.reader([first[0][0]], delimiter=delimiter)) if first else []
    if by_index:
        if len(names) != len(usecols) or len(kinds) != len(usecols):
            raise ValueError("there must be a name and a type for each column")
        if len(set(usecols)) != len(usecols) or len(set(names)) != len(names):
            raise ValueError("columns are used once")
        if any(not 0 <= c < len(head) for c in usecols):
            raise ValueError("no such column")
        chosen = {c: (n, k) for c, n, k in zip(usecols, names, kinds, strict=True)}
        fields = [chosen.get(i, (f"_skip{i}", T.StringType())) for i in range(len(head))]
        wanted = [chosen[c][0] for c in sorted(chosen)]
    else:
        used = head if usecols is None else list(usecols)
        if len(set(used)) != len(used):
            raise ValueError("columns are used once")
        if missing := [c for c in used if c not in head]:
            raise ValueError(f"no column {missing[0]!r}")
        if len(kinds) != len(used):
            raise ValueError("there must be a type for each column")
        kind_of = dict(zip(used, kinds, strict=True))
        fields = [(n, kind_of.get(n, T.StringType())) for n in head]
        wanted = [n for n in head if n in kind_of]
    schema = T.StructType([T.StructField(n, k) for n, k in fields])
    reader = spark.read.option("header", not by_index).option("sep", delimiter).option("enforceSchema", True).schema(schema)
    if not na_filter:
        reader = reader.option("nullValue", "\0").option("emptyValue", "")
    return reader.csv(paths).select(*[F.col(f"`{n}`") for n in wanted])


def _new_folder(df: DataFrame, path: str) -> None:
    """ValueError if the folder has files in it."""
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(folder) and len(system.listStatus(folder)):
        raise ValueError(f"{path} isn't empty")


def parquet_write(df: DataFrame, path: str | Path) -> None:
    """A file for each partition, into a new or empty folder."""
    _new_folder(df, path)
    df.write.mode("append").parquet(str(path))


def csv_write(df: DataFrame, path: str | Path, delimiter: str = ",") -> None:
    """A file with a header for each partition, into a new or empty folder."""
    if len(delimiter) != 1:
        raise ValueError("a delimiter is one character")
    _new_folder(df, path)
    df.write.mode("append").option("header", True).option("sep", delimiter).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(str(path))


def from_arrow(spark: SparkSession, data: Any) -> DataFrame:
    """An Arrow table, or an array or scalar as the column ``value``."""
    import pyarrow as pa

    if type(data).__module__.startswith("pandas"):
        data = pa.Table.from_pandas(data, preserve_index=False)
    if isinstance(data, pa.Scalar):
        data = pa.array([data.as_py()], data.type)
    if isinstance(data, (pa.Array, pa.ChunkedArray)):
        data = pa.table({"value": data})
    return spark.createDataFrame(data)


def from_array(spark: SparkSession, values: Any) -> DataFrame:
    """A one-dimensional NumPy array as the column ``value``."""
    import pyarrow as pa

    return from_arrow(spark, pa.array(values))


def to_arrow(df: DataFrame):
    """All rows at once, on the driver."""
    return df.toArrow()


def to_array(df: DataFrame, out: Any = None, writeable: bool = True):
    """A NumPy array of one column, or of rows by columns, on the driver; ValueError if there is a null. The values go
    into ``out`` if that is given; an array that isn't ``writeable`` is read-only."""
    data = df.toArrow()
    if any(c.null_count for c in data.columns):
        raise ValueError("nulls have no place in an array")
    import numpy as np

    columns = [c.to_numpy() for c in data.columns]
    values = columns[0] if len(columns) == 1 else np.stack(columns, 1)
    if out is not None:
        out[...] = values
        return out
    values = np.array(values)
    values.flags.writeable = writeable
    return values


def describe(df: DataFrame, rows: int = 5) -> str:
    """The first rows and the types of a table, for display."""
    head = df.limit(rows).toArrow().to_pylist()
    kinds = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in df.schema)
    return "\n".join([f"[{kinds}]", *(str(tuple(r.values())) for r in head)])


def sequence(spark: SparkSession, size: int, init: int = 0, name: str = "value") -> DataFrame:
    """The whole numbers ``init`` to ``init + size - 1``."""
    return spark.range(init, init + size).withColumnRenamed("id", name)


def offload(df: DataFrame, target: str = "disk") -> DataFrame:
    """Keeps the rows on the executors once they are computed: on ``disk``, or in ``memory`` as far as they fit."""
    from pyspark import StorageLevel

    levels = {"disk": StorageLevel.DISK_ONLY, "memory": StorageLevel.MEMORY_AND_DISK}
    if target not in levels:
        raise ValueError(f"unknown target {target!r}; known: {', '.join(levels)}")
    return df.persist(levels[target])
