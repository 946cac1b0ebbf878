"""Operators 2 and 6: round trips through the written files."""

import hashlib
import struct
import tarfile
import zlib

import pytest
from pyspark.sql import functions as F

from colframe.llm import media, queries, store, warc


def test_media_rows(spark, odd):
    rows = media.media_columns(odd).collect()
    assert len(rows) == odd.count()
    texts = {}
    for r in odd.collect():
        texts.setdefault(r.doc_id, set()).add((r.text or "").encode())
    for r in rows:
        payloads = [t + b"\0" * (-len(t) % 64 if t else 64) for t in texts[r.doc_id] if len(t) == r.n_bytes]
        payload = next(p for p in payloads if hashlib.sha256(p).hexdigest() == r.payload_sha256)
        assert (r.payload_bytes, r.tail_crc32, r.width * r.height) == (len(payload), zlib.crc32(payload[-64:]), len(payload))
        with open(r.shard.removeprefix("file://"), "rb") as f:
            f.seek(r.offset)
            image = f.read(r.media_bytes)
        assert hashlib.sha256(image).hexdigest() == r.media_sha256 and media.from_png(image) == payload
    by_text = {(r.payload_sha256): (r.shard, r.offset, r.feature) for r in rows}
    assert all(by_text[r.payload_sha256] == (r.shard, r.offset, r.feature) for r in rows)
    with tarfile.open(rows[0].shard.removeprefix("file://")) as t:
        names = t.getnames()
    assert len(names) == len(set(names)) and all(n.endswith(".png") for n in names)


def test_media_empty(empty):
    assert media.media_columns(empty).count() == 0


def test_media_damage_is_found(spark, odd):
    rows = media.write_media(odd)
    place = media.stored(rows).first()
    with open(place.shard.removeprefix("file://"), "r+b") as f:
        f.seek(place.offset + 45)
        f.write(b"\xff\xff\xff")
    with pytest.raises(Exception):  # noqa: B017
        media.media_features(media.stored(rows)).collect()


def test_png_is_one():
    image = media.to_png(b"ab" * 64)
    assert media.png_header(image[:33]) == (64, 2, 8, "grey") and struct.unpack(">I", image[8:12])[0] == 13


PAGES = [(1, "u1", "<p>a</p>"), (2, "u2", "<p>a</p>"), (3, None, None), (4, "u\r\nX: y", ""), (0, "u0", "<p>b</p>"), (5, "u5", "<p>b</p>"), (None, "u6", "<p>b</p>"), (7, "u7", "é" * 100), (2, "u2", "<p>a</p>"), (8, "u8", "z" * 200000)]


def test_warc_round_trip(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    index = warc.write_warc(df)
    rows = warc.read_warc(index).collect()
    got = sorted(((r.key, r.record_type, r.refers_to, r.payload_bytes, bytes(r.payload) if r.payload is not None else None) for r in rows), key=repr)
    want = []
    for key, _, html in PAGES:
        body = (html or "").encode()
        first = min(k for k, _, h in PAGES if (h or "").encode() == body and k is not None)
        want.append((key, "response", None, len(body), body) if key == first else (key, "revisit", first, len(body), None))
    assert got == sorted(want, key=repr)
    assert {r.payload_digest for r in rows if r.key == 7} == {warc.base32_sha1(("é" * 100).encode())}
    part = index.where("key in (7, 8)")
    assert {r.key for r in warc.read_warc(part).collect()} == {7, 8}


def test_warc_least_bytes(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    kinds = {(r.key, r.record_type) for r in warc.read_warc(warc.write_warc(df, least_bytes=1)).collect()}
    assert (3, "response") in kinds and (4, "response") in kinds and (5, "revisit") in kinds


def test_warc_empty(spark):
    assert warc.read_warc(warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_ranges(tmp_path):
    f = store.PartFile(f"file://{tmp_path}/x", ".bin")
    data = [bytes([i % 251]) * (i * 37 % 900) for i in range(500)]
    spans = [(f.uri, f.write(d), len(d), i) for i, d in enumerate(data)]
    f.close()
    for some in (spans, spans[::7], [s for s in spans for _ in range(2)]):
        assert all(b == data[i] for i, b in store.read_ranges(some, gap=50, most=3000))
        assert len(list(store.read_ranges(some))) == len(some)


def test_query_op6(spark, data):
    docs = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = queries.op6_media(spark, data).collect()
    assert len(rows) == len(docs)
    for r in rows:
        t = docs[r.doc_id]
        p = t + b"\0" * (-len(t) % 64 if t else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
