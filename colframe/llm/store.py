"""The shared folder of a session, tables written into it, and files in it."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import os
import posixpath
import shutil
import tempfile
import uuid
import zipfile
from bisect import bisect_left
from pathlib import Path
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes and rows that one Arrow batch hands to Python at most, and Spark's own settings of both.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2000
BATCH_SETTINGS = (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", str(BATCH_ROWS)), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", str(BATCH_BYTES)))
#: Spark deletes the shuffle files of a statement at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of a row group of facts.
FACT_BYTES = 1 << 20


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, unless PYTHONPATH leads them to it."""
    top = Path(__file__).resolve().parents[2]
    if str(top) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(spark.sparkContext, "_colframe_sent", False):
        return
    with tempfile.NamedTemporaryFile(prefix="colframe-", suffix=".zip", delete=False) as f, zipfile.ZipFile(f, "w") as z:
        for p in (top / "colframe").rglob("*.py"):
            z.write(p, p.relative_to(top))
    spark.sparkContext.addPyFile(f.name)
    spark.sparkContext._colframe_sent = True


def limit_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for Python workers that share an executor's memory. What operators return is
    planned later, so the limits stay in the session; one that has limits of its own keeps them."""
    ship(spark)
    for name, usual, ours in BATCH_SETTINGS:
        if spark.conf.get(name) == usual:
            spark.conf.set(name, ours)


@functools.lru_cache(maxsize=1)
def _trim():
    """The C library's call that hands free memory back to the system; None where it has no such call."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def gives_back(run):
    """A function over batches that hands memory it freed back to the system when a task ends. Spark keeps workers for later tasks,
    and what an earlier stage left in their heaps counts against the executor's memory all along."""

    @functools.wraps(run)
    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if _trim():
                _trim()(0)

    return tidy


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """One setting of the session, put back at the end."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def shared_root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where it is unset, a temporary one if all tasks run on this machine, as
    in tests; an error on a cluster, whose executors wouldn't see it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "_colframe_root", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + (made := tempfile.mkdtemp(prefix="colframe-shared-"))
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        spark.sparkContext._colframe_root = root
    return root if "://" in root or root.startswith("file:") else "file://" + posixpath.abspath(root)


def new_folder(spark: SparkSession, label: str) -> str:
    """URI of a folder of its own below the shared one."""
    return f"{shared_root(spark).rstrip('/')}/colframe-{label}-{uuid.uuid4().hex}"


def save(df: DataFrame, folder: str, codec: str = "zstd", **options: str) -> None:
    """``df`` as Parquet in ``folder``; its shuffle files go at once."""
    with setting(df.sparkSession, CLEANUP, "true"):
        df.write.options(compression=codec, **options).parquet(folder)


def written(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """``df`` written as Parquet into the shared folder and read from there: its lineage ends here."""
    spark = df.sparkSession
    folder = new_folder(spark, label)
    save(df, folder, codec)
    table = spark.read.schema(df.schema).parquet(folder)
    table._colframe_folder = folder
    return table


def release(*tables: DataFrame | None) -> None:
    """Deletes tables that ``written`` wrote and nothing reads any more."""
    for table in tables:
        if table is not None:
            remove(table._colframe_folder)


def numbered(df: DataFrame, label: str) -> DataFrame:
    """``df`` written with a number ``row`` of each row, which ascend within a file."""
    return written(df.withColumn("row", F.monotonically_increasing_id()), label)


class Beside:
    """Facts about rows that ``numbered`` has numbered, in files sorted by number. Tasks that read those rows read the facts
    of their own rows from here, so a long text needn't move to meet what is known of it.

    The driver holds a line for each file, of which there are as many as shuffle partitions at most; a task holds a few row
    groups of FACT_BYTES."""

    def __init__(self, facts: DataFrame, label: str):
        spark = facts.sparkSession
        self.folder, self.schema = new_folder(spark, label), facts.schema
        once = written(facts, label)  # the ranges are found in a pass of its own
        save(once.repartitionByRange("row").sortWithinPartitions("row"), self.folder, **{"parquet.block.size": str(FACT_BYTES)})
        release(once)
        found = spark.read.schema(self.schema).parquet(self.folder).groupBy(F.input_file_name().alias("file")).agg(F.min("row").alias("a"), F.max("row").alias("b")).collect()
        self.files = sorted((r.a, r.b, unquote(r.file)) for r in found)

    def release(self) -> None:
        remove(self.folder)

    def merged(self, batches, columns: list[str]):
        """Parts of the batches, whose first column is ``row``, each with its facts: those columns as one table in the order of the rows,
        and where each row's begin, and after the last, end."""
        reader = _Facts(self.files, ["row", *columns])
        for batch in batches:
            row = batch.column(0).to_numpy()
            jump = np.flatnonzero((np.diff(row) < 0) | (np.diff(row >> 33) != 0)) + 1
            for a, b in zip([0, *jump.tolist()], [*jump.tolist(), len(row)], strict=True):
                if b > a:
                    facts, numbers = reader.between(int(row[a]), int(row[b - 1]))
                    lo, hi = np.searchsorted(numbers, row[a:b]), np.searchsorted(numbers, row[a:b], "right")
                    yield batch.slice(a, b - a), facts, lo, hi


class _Facts:
    """The rows of sorted files, a few row groups in memory at a time."""

    def __init__(self, files: list[tuple[int, int, str]], columns: list[str]):
        self.files, self.columns, self.at, self.open, self.groups = files, columns, None, None, {}

    def _group(self, k: int, i: int) -> pa.Table:
        if (k, i) not in self.groups:
            if len(self.groups) >= 4:
                self.groups.pop(next(iter(self.groups)))
            table = self.open.read_row_group(i, columns=self.columns)
            self.groups[k, i] = table.column("row").to_numpy(), table
        return self.groups[k, i]

    def between(self, a: int, b: int) -> tuple[pa.Table | None, np.ndarray]:
        tables, numbers = [], []
        k = bisect_left(self.files, a, key=lambda f: f[1])
        while k < len(self.files) and self.files[k][0] <= b:
            if self.at != k:
                system, path = open_fs(self.files[k][2])
                self.at, self.open = k, pq.ParquetFile(system.open_input_file(path))
                head = self.open.metadata
                where = [head.schema.column(c).path for c in range(head.num_columns)].index("row")
                self.ends = [(x.min, x.max) for i in range(head.num_row_groups) if (x := head.row_group(i).column(where).statistics)]
            for i, (low, high) in enumerate(self.ends):
                if high >= a and low <= b:
                    own, table = self._group(k, i)
                    part = slice(int(np.searchsorted(own, a)), int(np.searchsorted(own, b, "right")))
                    tables.append(table.slice(part.start, part.stop - part.start))
                    numbers.append(own[part])
            k += 1
        if not tables:
            return None, np.zeros(0, np.int64)
        return pa.concat_tables(tables), np.concatenate(numbers)


def without(rows: DataFrame, gone: DataFrame, label: str = "gone") -> DataFrame:
    """The rows that ``numbered`` wrote, without those whose ``row`` is in ``gone``; they stay where they are."""
    spark, names = rows.sparkSession, rows.columns
    limit_batches(spark)
    beside = Beside(gone.select("row").distinct(), label)

    def run(batches):
        for batch, _, lo, hi in beside.merged(batches, []):
            yield batch.filter(pa.array(lo == hi))

    first = rows.select("row", *[f"`{c}`" for c in names if c != "row"])
    return first.mapInArrow(run, first.schema).select(*[f"`{c}`" for c in names])


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; local, HDFS, S3 and GCS ones."""
    return fs.FileSystem.from_uri(uri.replace("file:///", "/").replace("file:/", "/"))


class PartFile:
    """A file that one task attempt writes: no other attempt has its name, and readers learn it from the rows
    that Spark keeps of the attempt that succeeded. What lost attempts leave is never read."""

    def __init__(self, folder: str, suffix: str):
        self.uri = f"{folder}/{uuid.uuid4().hex}{suffix}"
        self.fs, path = open_fs(self.uri)
        self.fs.create_dir(posixpath.dirname(path), recursive=True)
        self.out, self.at = self.fs.open_output_stream(path, compression=None), 0

    def write(self, data: bytes) -> int:
        """Offset of ``data`` in the file."""
        at = self.at
        self.out.write(data)
        self.at += len(data)
        return at

    def close(self) -> None:
        self.out.close()


def read_ranges(rows, gap: int = 1 << 16, most: int = 8 << 20):
    """``(uri, offset, length, row)`` sorted by uri and offset -> ``(row, bytes)``.

    Neighbouring ranges less than ``gap`` bytes apart are read at once, ``most`` bytes at a time (one longer
    record is still read whole); ranges may repeat and overlap."""
    opened, group, end = (None, None), [], 0

    def flush():
        if group:
            first = group[0][1]
            opened[1].seek(first)
            data = opened[1].read(end - first)
            for _, at, n, row in group:
                yield row, data[at - first : at - first + n]

    for item in rows:
        uri, at, n, _ = item
        if group and (uri != opened[0] or at > end + gap or max(end, at + n) - group[0][1] > most):
            yield from flush()
            group = []
        if uri != opened[0]:
            if opened[1]:
                opened[1].close()
            system, path = open_fs(uri)
            opened = (uri, system.open_input_file(path))
        end = max(end, at + n) if group else at + n
        group.append(item)
    yield from flush()
    if opened[1]:
        opened[1].close()


def _bytes(spark: SparkSession, name: str) -> int:
    """A setting that is a number of bytes."""
    size = spark.conf.get(name).lower().rstrip("b")
    unit = {"k": 10, "m": 20, "g": 30, "t": 40}.get(size[-1], 0)
    return int(size.rstrip("kmgt")) << unit


def read_tasks(spark: SparkSession, total: int) -> int:
    """How many tasks read so many bytes of files: by the rule of Spark's own scans, a task for each
    ``spark.sql.files.maxPartitionBytes``, or for less while cores would be idle, but not below the cost of opening a file."""
    most, least = (_bytes(spark, f"spark.sql.files.{n}") for n in ("maxPartitionBytes", "openCostInBytes"))
    share = min(most, max(least, -(-total // spark.sparkContext.defaultParallelism)))
    return max(1, -(-total // share))


def by_place(places: DataFrame, file: str, offset: str = "offset", length: str = "length") -> DataFrame:
    """Ranges of files, sorted within ranges of ``file`` and ``offset``. They are dealt out by the bytes that they stand for, as
    a scan of those files would be, and not by those of the table that names them."""
    total = places.agg(F.sum(length)).first()[0] or 0
    return places.repartitionByRange(read_tasks(places.sparkSession, total), file, offset).sortWithinPartitions(file, offset)


def remove(uri: str) -> None:
    """Delete a folder of intermediate files that nothing reads any more."""
    system, path = open_fs(uri)
    if system.get_file_info(path).type != fs.FileType.NotFound:
        system.delete_dir(path)


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, null as empty."""
    return [x if x is not None else b"" for x in column.cast(pa.binary()).to_pylist()]
