"""Media columns: content-addressed images in tar shards (operator 6).

A payload is kept losslessly as an 8-bit greyscale PNG of 64 samples a row. A task stores each image that it
meets once, as a tar member named by its digest. Rows carry digest, shard, offset and length. Of images that several
tasks stored, one is chosen for all rows. Reading goes through the chosen places in the order of their
offsets; metadata columns come from range reads of the images' headers alone.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import PartFile, by_place, limit_batches, new_folder, read_ranges, save, utf8, written

WIDTH = 64
#: A tar shard is closed, and the next begun, beyond this size.
SHARD_BYTES = 1 << 30
#: Bytes of a PNG that hold its signature and header chunk.
HEADER_BYTES = 33
#: Digests that a task remembers; a payload that it forgot is stored once more.
REMEMBERED = 1_000_000

ROWS = "key {kind}, n_bytes long, digest string, shard string, offset long, length long"


def padded(data: bytes) -> bytes:
    """Zero bytes appended up to a positive multiple of WIDTH."""
    return data + b"\0" * (-len(data) % WIDTH if data else WIDTH)


def to_png(payload: bytes) -> bytes:
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)  # the first byte of a row names its filter: none
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int, str]:
    """Width, height, bits a sample and kind, from the first HEADER_BYTES."""
    if head[:8] != b"\x89PNG\r\n\x1a\n" or head[12:16] != b"IHDR":
        raise ValueError("not a PNG image")
    width, height, depth, colour = struct.unpack(">IIBB", head[16:26])
    return width, height, depth, "grey" if colour == 0 else f"colour {colour}"


def from_png(data: bytes) -> bytes:
    """Samples of an image that ``to_png`` made; its chunks' checksums are verified."""
    width, height, depth, kind = png_header(data)
    if (width, depth, kind) != (WIDTH, 8, "grey"):
        raise ValueError("not an image of this store")
    at, packed = 8, b""
    while at < len(data):
        n, name = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if zlib.crc32(name + body) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("an image is damaged")
        packed += body if name == b"IDAT" else b""
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, WIDTH + 1)
    return rows[:, 1:].tobytes()


def features(samples: bytes) -> str:
    """Mean and deviation of the samples, and a 64-bit hash of which of 8 x 8 blocks lie above the mean block; all
    from whole numbers, so equal samples have equal features anywhere."""
    x = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH).astype(np.int64)
    n, total, squares = x.size, int(x.sum()), int((x * x).sum())
    edges = [len(x) * i // 8 for i in range(9)]
    blocks = [int(x[a : max(b, a + 1), 8 * j : 8 * j + 8].sum()) // max(1, max(b, a + 1) - a) for a, b in zip(edges[:-1], edges[1:], strict=True) for j in range(8)]
    bits = sum((64 * b > sum(blocks)) << i for i, b in enumerate(blocks))
    return f"mean={total // n}.{total % n * 100 // n:02d};var={(squares * n - total * total) // (n * n)};hash={bits:016x}"


def write_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Stores the UTF-8 bytes of each text (null as empty), padded to a multiple of 64, and returns one row for
    each row of ``df``: ``key, n_bytes, digest, shard, offset, length``; rows with equal payloads share a place.
    The rows, and the place of each digest, are kept as Parquet beside the shards."""
    spark = df.sparkSession
    limit_batches(spark)
    folder = folder or new_folder(spark, "media")
    schema = T.StructType([T.StructField("key", df.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), *(T.StructField(n, T.StringType()) for n in ("digest", "shard")), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())])

    def run(batches):
        out, places = None, {}
        for batch in batches:
            rows = []
            for data in utf8(batch.column(1)):
                payload = padded(data)
                digest = hashlib.sha256(payload).digest()
                if digest not in places:
                    if out is None or out.at > SHARD_BYTES:
                        if out:
                            out.write(b"\0" * 1024)
                            out.close()
                        out = PartFile(folder, ".tar")
                    if len(places) >= REMEMBERED:
                        places.clear()
                    image = to_png(payload)
                    info = tarfile.TarInfo(digest.hex() + ".png")
                    info.size = len(image)
                    out.write(info.tobuf(tarfile.PAX_FORMAT))
                    places[digest] = (out.uri, out.write(image), len(image))
                    out.write(b"\0" * (-len(image) % 512))
                rows.append((len(data), digest.hex(), *places[digest]))
            made = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(x), k) for x, k in zip(made, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True))], names=[f.name for f in schema])
        if out:
            out.write(b"\0" * 1024)
            out.close()

    df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema).write.option("compression", "zstd").parquet(f"{folder}/rows")
    rows = spark.read.schema(schema).parquet(f"{folder}/rows")
    save(stored(rows), f"{folder}/places")
    return _placed(rows, spark.read.parquet(f"{folder}/places"))


def _placed(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows with what a table has of their digests. Both are tables, so Spark can split a digest of very many rows."""
    return rows.select("key", "n_bytes", "digest").join(facts, "digest").select("key", "n_bytes", "digest", *[c for c in facts.columns if c != "digest"])


def stored(rows: DataFrame) -> DataFrame:
    """One place for each digest: the first by shard and offset."""
    return rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("p")).select("digest", "p.*")


def _ordered(places: DataFrame) -> DataFrame:
    return by_place(places.select("shard", "offset", "length", "digest"), "shard")


def _spans(batches, length=None):
    for b in batches:
        for shard, offset, n, digest in zip(*(c.to_pylist() for c in b.columns), strict=True):
            yield shard, offset, min(n, length or n), (digest, n)


def _grouped(rows, schema, size=500):
    """Record batches of an iterator of tuples."""
    block = []
    for row in rows:
        block.append(row)
        if len(block) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*block, strict=True), schema, strict=True)], schema=schema)
            block = []
    if block:
        yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*block, strict=True), schema, strict=True)], schema=schema)


def media_metadata(places: DataFrame) -> DataFrame:
    """``digest, width, height, bits, kind`` of stored images, from range reads of their headers alone."""
    limit_batches(places.sparkSession)
    schema = pa.schema([("digest", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("bits", pa.int32()), ("kind", pa.string())])

    def run(batches):
        yield from _grouped(((row[0], *png_header(head)) for row, head in read_ranges(_spans(batches, HEADER_BYTES), gap=4096)), schema)

    return _ordered(places).mapInArrow(run, "digest string, width int, height int, bits int, kind string")


def media_features(places: DataFrame) -> DataFrame:
    """``digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature``, from the stored
    bytes. An image whose samples don't have its digest raises an error."""
    limit_batches(places.sparkSession)
    fields = [("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]

    def of(row, image):
        samples = from_png(image)
        digest = hashlib.sha256(samples).hexdigest()
        if digest != row[0]:
            raise ValueError(f"the image {row[0]} holds other samples")
        return row[0], len(samples), digest, zlib.crc32(samples[-WIDTH:]), len(image), hashlib.sha256(image).hexdigest(), features(samples)

    def run(batches):
        yield from _grouped((of(row, image) for row, image in read_ranges(_spans(batches))), pa.schema(fields))

    return _ordered(places).mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text as an image and returns, for each row of ``df``, its id, ``n_bytes``, the place of its image
    (``shard, offset, length``), ``width, height`` from headers alone, and the features of the stored bytes. Equal
    texts have equal values; repeated rows stay; null and empty texts are 64 zero bytes."""
    folder = new_folder(df.sparkSession, "media")
    write_media(df, id_col, text_col, folder)
    places = df.sparkSession.read.parquet(f"{folder}/places")  # an image is read once, however many rows share it
    # the payload's digest, which reading has verified, is kept once
    facts = places.join(media_features(places).drop("payload_sha256"), "digest").join(media_metadata(places).select("digest", "width", "height"), "digest")
    rows = _placed(df.sparkSession.read.parquet(f"{folder}/rows"), written(facts, "media-facts"))
    return rows.select(F.col("key").alias(id_col), "n_bytes", "payload_bytes", F.col("digest").alias("payload_sha256"), "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "shard", "offset", "length")
