"""A content-addressed store of token ids (operator 5).

A text's ids are cut where a rolling hash of the last ids says so, so equal passages give equal chunks wherever they
stand. Encoding tasks write the chunks that they meet into staging packs, once each. Of a chunk that several tasks
wrote, one copy is chosen, and only chosen copies go into the store's packs. Documents are recipes: lists of
chunk digests, written in the order of their ids, with the place of their first id in the whole stream. A Merkle root
over its chunks' digests verifies a document. The manifest has one over the recipes of each file, and both are checked on
reading.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import table_encoder, vocabulary
from .media import _grouped
from .store import PartFile, by_place, limit_batches, new_folder, read_ranges, release, remove, written

#: A chunk ends after LEAST ids at least, where the hash of the last LOOK ids has MASK's bits clear, or at MOST ids.
LEAST, LOOK, MASK, MOST = 128, 16, (1 << 9) - 1, 4096
#: Ids that are hashed at once, or those of one text.
HASHED = 1 << 16
#: A pack is closed, and the next begun, beyond this size.
PACK_BYTES = 1 << 30
#: Digests that a task remembers; a chunk that it forgot is staged once more.
REMEMBERED = 1_000_000


@lru_cache(maxsize=1)
def _values() -> np.ndarray:
    return np.random.default_rng(5).integers(0, 1 << 64, 1 << 18, np.uint64)


def _cuts(ids: np.ndarray) -> np.ndarray:
    """Where the hash of the last LOOK ids lets a chunk end."""
    h = _values()[ids & 0x3FFFF]
    for k in (1, 2, 4, 8):  # a rolling hash of LOOK ids, by doubling: each id counts by its distance
        y = h.copy()
        y[k:] += h[:-k] * np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64))
        h = y
    return np.flatnonzero((h >> np.uint64(40)) & np.uint64(MASK) == 0) + 1


def _ends(n: int, cuts: list[int]) -> list[int]:
    out, at = [], 0
    while n - at > LEAST:
        k = bisect_left(cuts, at + LEAST)
        at = min(cuts[k] if k < len(cuts) else n, at + MOST, n)
        out.append(at)
    if at < n:
        out.append(n)
    return out


def chunk_ends(ids: np.ndarray) -> list[int]:
    """Where chunks end; they depend on the ids since the last end alone."""
    return _ends(len(ids), _cuts(ids).tolist() if len(ids) > LEAST else [])


def chunked(texts: Iterable[np.ndarray]) -> Iterator[tuple[np.ndarray, list[int]]]:
    """The ids of each text, and its ``chunk_ends``. Short texts are hashed together: a chunk ends behind LEAST ids of its text, which
    are more than the LOOK ids that the hash sees, so it sees none of the text before."""
    held, size = [], 0
    for ids in texts:
        if held and size + len(ids) > HASHED:
            yield from _chunked(held)
            held, size = [], 0
        held.append(ids)
        size += len(ids)
    if held:
        yield from _chunked(held)


def _chunked(texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, list[int]]]:
    together = np.concatenate(texts)
    cuts, edge = _cuts(together) if len(together) > LEAST else np.zeros(0, np.int64), np.cumsum([0, *map(len, texts)])
    own = np.searchsorted(cuts, edge, "right").tolist()
    for ids, first, a, b in zip(texts, edge.tolist(), own, own[1:], strict=False):
        yield ids, _ends(len(ids), (cuts[a:b] - first).tolist())


def merkle_root(digests: list[bytes]) -> bytes:
    """Root of a binary tree over digests, a lone node going up as it is; leaves and inner nodes are hashed apart."""
    level = [hashlib.blake2b(b"\0" + d, digest_size=16).digest() for d in digests] or [hashlib.blake2b(b"", digest_size=16).digest()]
    while len(level) > 1:
        level = [hashlib.blake2b(b"\1" + level[i] + level[i + 1], digest_size=16).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


@lru_cache(maxsize=1)
def _codec():
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def packed(ids: np.ndarray, width: int) -> bytes:
    """The bytes of a chunk in a pack: ids of ``width`` bytes, little-endian, compressed."""
    return _codec()[0].compress(ids.astype(f"<u{width}").tobytes())


def unpacked(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(_codec()[1].decompress(data), f"<u{width}").astype(np.uint32)


def chunk_digest(ids: np.ndarray) -> bytes:
    return hashlib.blake2b(ids.astype("<u4").tobytes(), digest_size=16).digest()


class TokenStore:
    """Tables and packs of a store in a folder: ``recipes`` (``key, start, n_tokens, root, chunks``, sorted by key) and
    ``index`` (``digest, n, pack, offset, length``), and ``manifest``, a Merkle root for each recipe file."""

    def __init__(self, spark: SparkSession, folder: str, width: int, key: T.DataType):
        self.spark, self.folder, self.width, self.key = spark, folder, width, key

    @property
    def recipes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/recipes")

    @property
    def index(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/index")

    @property
    def manifest(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/manifest")

    def chunks(self, ids: bool = True) -> DataFrame:
        """``digest, n, crc32`` of each chunk in the packs, read in the order of their offsets and verified, and
        with ``ids`` the ids themselves. ``crc32`` is that of the ids as little-endian 32-bit integers."""
        limit_batches(self.spark)
        width = self.width
        schema = pa.schema([("digest", pa.binary()), ("n", pa.int64()), ("crc32", pa.int64()), *([("ids", pa.list_(pa.int32()))] if ids else [])])

        def of(row, data):
            x = unpacked(data, width)
            if chunk_digest(x) != row:
                raise ValueError("a chunk isn't what its digest says")
            return (row, len(x), zlib.crc32(x.astype("<u4").tobytes()), *([x.astype(np.int32)] if ids else []))

        def spans(batches):
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        def run(batches):
            yield from _grouped((of(row, data) for row, data in read_ranges(spans(batches))), schema)

        places = by_place(self.index.select("pack", "offset", "length", "digest"), "pack")
        return places.mapInArrow(run, "digest binary, n long, crc32 long" + ", ids array<int>" * ids)

    def verify(self) -> None:
        """Raises an error if a recipe file isn't the one of the manifest, is missing, or isn't in it."""
        limit_batches(self.spark)
        there, known = _roots(self.recipes), self.manifest
        odd = known.join(there.select(F.col("part").alias("part_there"), F.col("root").alias("root_there")), F.col("part") == F.col("part_there"), "full")
        if not odd.where(~F.col("root").eqNullSafe(F.col("root_there"))).isEmpty():
            raise ValueError("recipes aren't what the manifest says")

    def _parts(self, ids: bool) -> DataFrame:
        """The chunks of each document, in any order."""
        steps = self.recipes.select("row", F.posexplode_outer("chunks").alias("pos", "digest"))
        return steps.join(self.chunks(ids), "digest", "left")

    def documents(self) -> DataFrame:
        """``key, start, ids``: every document put together from its chunks. Verifies the manifest at once, and each
        document's Merkle root when rows are read; a chunk that isn't in the index raises an error."""
        self.verify()
        parts = self._parts(True).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "ids"))).alias("parts"))
        rows = self.recipes.select("row", "key", "start", "root").join(parts, "row")
        rows = rows.select("key", "start", "root", F.col("parts.digest").alias("digests"), F.col("parts.ids").alias("ids"))

        def run(batches):
            for b in batches:
                if b.column(4).flatten().null_count:
                    raise ValueError("a chunk isn't in the index")
                for root, digests in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    if merkle_root(digests) != root:
                        raise ValueError("a document isn't what its recipe says")
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(4)], names=["key", "start", "ids"])

        schema = T.StructType([T.StructField("key", self.key), T.StructField("start", T.LongType()), T.StructField("ids", T.ArrayType(T.ArrayType(T.IntegerType())))])
        return rows.mapInArrow(run, schema).select("key", "start", F.flatten("ids").alias("ids"))

    def checksums(self) -> DataFrame:
        """``key, start, n_tokens, ids_crc32``: from the chunks' own sums, which combine to their document's; ids
        aren't moved, and a common chunk is read once. Verifies as ``documents`` does."""
        self.verify()
        parts = self._parts(False).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "n", "crc32"))).alias("parts"))
        rows = self.recipes.select("row", "key", "start", "root").join(parts, "row").select("key", "start", "root", F.col("parts.digest"), F.col("parts.n"), F.col("parts.crc32"))
        schema = T.StructType([T.StructField("key", self.key), *(T.StructField(n, T.LongType()) for n in ("start", "n_tokens", "ids_crc32"))])

        def run(batches):
            for b in batches:
                made = []
                for root, digests, ns, crcs in zip(*(c.to_pylist() for c in b.columns[2:]), strict=True):
                    if merkle_root(digests) != root:
                        raise ValueError("a document isn't what its recipe says")
                    if None in ns:
                        raise ValueError("a chunk isn't in the index")
                    total, crc = 0, 0
                    for n, c in zip(ns, crcs, strict=True):
                        crc, total = crc_combined(crc, c, 4 * n), total + n
                    made.append((total, crc))
                n, crc = zip(*made, strict=True) if made else ((), ())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["key", "start", "n_tokens", "ids_crc32"])

        return rows.mapInArrow(run, schema)


def _roots(recipes: DataFrame) -> DataFrame:
    """``part, documents, n_tokens, root`` of each recipe file: the Merkle root over its recipes in their order, each as
    its row, key, start, number of tokens and root."""
    held = F.when(F.col("key").isNotNull(), F.lit("k")).otherwise(F.lit(""))
    named = F.concat_ws(" ", "row", "start", "n_tokens", held, F.coalesce(F.col("key").cast("string"), F.lit("")))
    leaf = F.unhex(F.sha2(F.concat(F.col("root"), named.cast("binary")), 256))
    parts = recipes.select("part", "row", "n_tokens", leaf.alias("leaf")).groupBy("part").agg(F.array_sort(F.collect_list(F.struct("row", "leaf"))).alias("x"), F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("n_tokens"))

    def run(batches):
        for b in batches:
            roots = [merkle_root(x) for x in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(roots, pa.binary())], names=["part", "documents", "n_tokens", "root"])

    return parts.select("part", "documents", "n_tokens", F.col("x.leaf")).mapInArrow(run, "part int, documents long, n_tokens long, root binary")


def _times(a: int, b: int) -> int:
    """Product of two polynomials over GF(2) modulo the CRC-32 polynomial, bits reversed."""
    out = 0
    while True:
        if a & 0x80000000:
            out ^= b
        a = a << 1 & 0xFFFFFFFF
        if not a:
            return out
        b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)


@lru_cache(maxsize=1 << 15)
def _shift(n: int) -> int:
    """x to the power 8 n."""
    out, square = 0x80000000, 0x00800000
    while n:
        if n & 1:
            out = _times(out, square)
        square, n = _times(square, square), n >> 1
    return out


def crc_combined(a: int, b: int, n: int) -> int:
    """CRC-32 of two byte strings put together, from their own and the length ``n`` of the second."""
    return _times(a, _shift(n)) ^ b


def write_tokens(df: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> TokenStore:
    """Encodes every text with the ``tokenizers`` library (null as empty), appends ``end_id``, and writes the store.

    Documents are in ascending order of their ids, null first; rows of one id are ordered by their contents. Empty
    texts are the end id alone."""
    spark = df.sparkSession
    limit_batches(spark)
    folder = folder or new_folder(spark, "tokens")
    width = 2 if max(vocabulary(tokenizer).size, end_id + 1) <= 1 << 16 else 4
    key = df.schema[id_col].dataType
    chunk = "array<struct<digest:binary,n:int,offset:long,length:int,fresh:boolean>>"
    schema = T.StructType([T.StructField("key", key), T.StructField("n_tokens", T.LongType()), T.StructField("root", T.BinaryType()), T.StructField("pack", T.StringType()), T.StructField("chunks", T.DataType.fromDDL(chunk))])

    def encode(batches):
        texts_to_ids, known, out = table_encoder(tokenizer, True), set(), None
        kind = pa.list_(pa.struct([("digest", pa.binary()), ("n", pa.int32()), ("offset", pa.int64()), ("length", pa.int32()), ("fresh", pa.bool_())]))
        for batch in batches:
            ns, roots, packs, lists = [], [], [], []
            found = texts_to_ids([t or "" for t in batch.column(1).to_pylist()])
            for ids, ends in chunked(np.append(ids, np.uint32(end_id)) for ids in found):
                if out is None or out.at > PACK_BYTES:
                    if out:
                        out.close()
                    out = PartFile(f"{folder}/staging", ".pack")
                chunks, at = [], 0
                for end in ends:
                    part, at = ids[at:end], end
                    digest = chunk_digest(part)
                    fresh = digest not in known
                    if fresh:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known.add(digest)
                        data = packed(part, width)
                        chunks.append({"digest": digest, "n": len(part), "offset": out.write(data), "length": len(data), "fresh": True})
                    else:
                        chunks.append({"digest": digest, "n": len(part), "offset": None, "length": None, "fresh": False})
                ns.append(len(ids))
                roots.append(merkle_root([c["digest"] for c in chunks]))
                packs.append(out.uri)
                lists.append(chunks)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), pa.array(roots, pa.binary()), pa.array(packs, pa.string()), pa.array(lists, kind)], names=["key", "n_tokens", "root", "pack", "chunks"])
        if out:
            out.close()

    df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(encode, schema).write.option("compression", "zstd").parquet(f"{folder}/staged")
    staged = spark.read.schema(schema).parquet(f"{folder}/staged")

    # one copy of each chunk, in the order of the staging packs
    copies = staged.select("pack", F.explode("chunks").alias("c")).where("c.fresh").select("c.digest", F.struct("pack", "c.offset", "c.length", "c.n").alias("p"))
    chosen = copies.groupBy("digest").agg(F.min("p").alias("p")).select("p.pack", "p.offset", "p.length", "digest", "p.n")
    index = pa.schema([("digest", pa.binary()), ("n", pa.int64()), ("pack", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def compact(batches):
        out = None

        def spans():
            for b in batches:
                for pack, offset, length, digest, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    yield pack, offset, length, (digest, n)

        def rows():
            nonlocal out
            for (digest, n), data in read_ranges(spans()):
                if out is None or out.at > PACK_BYTES:
                    if out:
                        out.close()
                    out = PartFile(f"{folder}/packs", ".pack")
                yield digest, n, out.uri, out.write(data), len(data)

        yield from _grouped(rows(), index, 2000)
        if out:
            out.close()

    chosen = written(chosen, "tokens-chosen")
    by_place(chosen, "pack").mapInArrow(compact, "digest binary, n long, pack string, offset long, length long").write.option("compression", "zstd").parquet(f"{folder}/index")

    release(chosen)

    # recipes in the order of the ids; starts from the sums of the ranges before, and within a range
    by_key = [F.col("key").asc_nulls_first(), F.col("n_tokens"), F.col("root")]
    ranges = staged.select("key", "n_tokens", "root", F.col("chunks.digest").alias("chunks")).repartitionByRange(*by_key).sortWithinPartitions(*by_key)
    ranges.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(f"{folder}/ranges")
    ranges = spark.read.parquet(f"{folder}/ranges")
    sums = ranges.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each range
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("row")) - F.col("n_tokens")
    recipes = ranges.withColumn("within", within).join(F.broadcast(before), "part")
    recipes.select("row", "part", "key", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "root", "chunks").sortWithinPartitions("row").write.option("compression", "zstd").parquet(f"{folder}/recipes")
    store = TokenStore(spark, folder, width, key)
    _roots(store.recipes).write.parquet(f"{folder}/manifest")
    for name in ("staging", "staged", "ranges"):
        remove(f"{folder}/{name}")
    return store
