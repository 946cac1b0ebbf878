"""WARC archives written with an index, and read back through it (operator 2).

Each task writes one gzip-membered archive; the rows that it returns are the index: offset, length, URL and
digest of each record. Selected records are read in the order of their offsets, neighbouring ranges at once.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import PartFile, by_place, limit_batches, new_folder, read_ranges, utf8, written

INDEX = T.StructType([T.StructField("key", T.LongType()), *(T.StructField(n, T.StringType()) for n in ("url", "digest", "record_type", "file")), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())])
#: Fixed values of the WARC 1.1 format: its profile of revisits, and the date that records carry when none is known.
REVISIT, DATE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "1970-01-01T00:00:00Z"
#: An archive is closed, and the next begun, beyond this size.
ARCHIVE_BYTES = 1 << 30


def record_id(key: int | None) -> str:
    return f"<urn:page:{'null' if key is None else key}>"


def key_of(record: str | None) -> int | None:
    text = (record or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text not in ("", "null") else None


def one_line(url: str) -> str:
    """A URL as a header's value: percent-encoded where a line end would break the header."""
    return "".join(c if c >= " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(key: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """A response with the payload, or, with ``refers_to``, a revisit with the response's headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(key)}", f"WARC-Date: {date}", f"WARC-Target-URI: {one_line(url)}", f"WARC-Payload-Digest: sha1:{digest}", f"Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]  # noqa: F541
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {REVISIT}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, HTTP head and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) < int(fields["Content-Length"]):
        raise ValueError("a WARC record is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def with_revisits(df: DataFrame, id_col: str, payload_col: str, least_bytes: int) -> DataFrame:
    """``key, payload, refers_to``: of rows with equal payloads, the smallest key that others refer to.

    Digests are grouped without their payloads; a table of the repeated ones alone, without each group's first,
    meets the payloads again, by key and digest, so a large group is dealt out evenly."""
    keyed = df.select(F.col(id_col).cast("long").alias("key"), F.sha1(F.coalesce(F.col(payload_col), F.lit("")).cast("binary")).alias("sha"), F.octet_length(F.coalesce(F.col(payload_col), F.lit(""))).alias("n"))
    keyed = written(keyed, "warc-keys")
    firsts = keyed.where(F.col("n") >= least_bytes).groupBy("sha").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)
    return keyed.where(F.col("n") >= least_bytes).join(firsts.select("sha", "first"), "sha").where(~F.col("key").eqNullSafe(F.col("first"))).select("key", "sha", F.col("first").alias("refers_to")).distinct()


def write_warc(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Writes a record for each row and returns the index, which is kept as Parquet beside the archives.

    Of rows whose payloads are equal and have ``least_bytes`` bytes or more, those with the smallest id are
    responses and the others revisits; a null payload is an empty one. Rows that share both that smallest id and
    the payload are all responses. Null ids count as larger than others, and refer to nothing where all are null.
    Returns ``key, url, digest, record_type, file, offset, length``."""
    spark = df.sparkSession
    limit_batches(spark)
    folder = folder or new_folder(spark, "warc")
    again = with_revisits(df, id_col, payload_col, least_bytes).where(F.col("refers_to").isNotNull())
    pages = df.select(F.col(id_col).cast("long").alias("key"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    pages = pages.withColumn("sha", F.sha1(F.col("payload").cast("binary")))
    same = pages["key"].eqNullSafe(again["key"]) & (pages["sha"] == again["sha"])
    rows = pages.join(again, same, "left").select(pages["key"], "url", "payload", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, schema = None, pa.schema([("key", pa.int64()), *((n, pa.string()) for n in ("url", "digest", "record_type", "file")), ("offset", pa.int64()), ("length", pa.int64())])
        for batch in batches:
            made = []
            for key, url, payload, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                if out is None or out.at > ARCHIVE_BYTES:
                    if out:
                        out.close()
                    out = PartFile(folder, ".warc.gz")
                digest = base32_sha1(payload)
                member = gzip.compress(record(key, url, payload, digest, first), 3, mtime=0)
                made.append((key, url, digest, "response" if first is None else "revisit", out.uri, out.write(member), len(member)))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*made, strict=True) if made else [[]] * len(schema), schema, strict=True)], schema=schema)
        if out:
            out.close()

    index = f"{folder}/index"
    rows.mapInArrow(run, INDEX).write.option("compression", "zstd").parquet(index)
    return spark.read.schema(INDEX).parquet(index)


def read_warc(index: DataFrame) -> DataFrame:
    """The records of an index, or of a part of it: ``key, url, record_type, payload_bytes, payload_digest,
    refers_to, payload``, all from the archives; a revisit has no payload of its own (null).

    Rows are sorted by file and offset within ranges of them, and ranges less than 64 KB apart are read at once.
    A response whose payload doesn't have its digest raises an error."""
    limit_batches(index.sparkSession)
    spans = by_place(index.select("file", "offset", "length"), "file")
    out = "key long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"

    def run(batches):
        schema = pa.schema([("key", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        rows, size = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        spans = ((f, o, n, None) for b in batches for f, o, n in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for _, data in read_ranges(spans):
            fields, http, payload = parsed(zlib.decompress(data, 31))
            revisit = fields["WARC-Type"] == "revisit"
            digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
            n = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
            if not revisit and (base32_sha1(payload) != digest or len(payload) != n):
                raise ValueError(f"the payload of {fields['WARC-Record-ID']} isn't what its record says")
            rows.append((key_of(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], fields["WARC-Type"], n, digest, key_of(fields.get("WARC-Refers-To")), None if revisit else payload))
            size += len(payload)
            if len(rows) >= 500 or size > 4 << 20:
                yield batch()
                rows.clear()
                size = 0
        if rows:
            yield batch()

    return spans.mapInArrow(run, out)
