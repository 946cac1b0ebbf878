"""Near-duplicate vectors by random hyperplanes (operator 7).

Each of several tables has hyperplanes of its own; the signs of a vector's products with them are its bucket. All vectors
of a bucket are compared. First by the signs of all tables, which are a few bytes: vectors that differ from all others of the bucket in
far more signs than a link may go no further. Then by exact cosine in double precision. A pair that meets in several tables counts in
the first. Equal vectors are one node with a size. A bucket sends on, for each of its nodes, how many vectors it links with there
and an edge of a forest that spans its links; pairs are never rows. Components come from those edges.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .store import limit_batches, release, written

#: Vectors of chance that a bucket holds at most, on average; a link at the threshold is missed with probability MISS.
BUCKET, MISS = 16, 0.001
#: Rows of one block of a large bucket; its blocks are compared two by two, in tasks of their own.
BLOCK = 1000
#: Deviations by which the number of unlike signs of a link at the threshold may lie above its mean: one in a hundred million lies beyond.
DEVIATIONS = 6
#: Rows whose signs are compared at once, and rows of a bucket up to which that is done for many buckets together.
TOGETHER, SMALL = 20_000, 64


def plan(n: int, least: float) -> tuple[int, int]:
    """Hyperplanes of a table, and tables, for ``n`` vectors."""
    bits = max(4, min(56, math.ceil(math.log2(max(2, n / BUCKET)))))
    agree = 1 - math.acos(least) / math.pi
    return bits, math.ceil(math.log(MISS) / math.log(1 - agree**bits))


def planes(size: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([7, size]).standard_normal((size, bits * tables))


def matrix(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """The vectors as double arrays, and which can link: not null, of some components, all finite, not all zero."""
    out, ok = [], np.zeros(len(column), bool)
    for i, v in enumerate(column):
        values = v.values if v.is_valid else None
        x = np.zeros(0) if values is None or values.null_count else values.to_numpy(zero_copy_only=False).astype(np.float64)
        ok[i] = len(x) > 0 and bool(np.isfinite(x).all()) and bool(x.any())
        out.append(x + 0.0)  # -0.0 as 0.0
    return out, ok


def most_unlike(signs: int, least: float) -> int:
    """Unlike signs of so many that a pair may have and be compared by its cosine."""
    p = math.acos(least) / math.pi
    return math.floor(signs * p + DEVIATIONS * math.sqrt(signs * p * (1 - p)))


def codes(signs: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Rows of packed signs -> the bucket number of each table."""
    side = np.unpackbits(signs.view(np.uint8), axis=1, count=bits * tables, bitorder="little").reshape(len(signs), tables, bits)
    return (side.astype(np.int64) << np.arange(bits, dtype=np.int64)).sum(2)


def _signed(df: DataFrame, id_col: str, vector_col: str, bits: int, tables: int, kind: str) -> DataFrame:
    """``key, digest, x, signs``: components as numbers of ``kind``, and the signs of all tables, in whole 64-bit words."""
    schema = df.select(F.col(id_col).alias("key")).schema.add("digest", "binary").add("x", "binary").add("signs", "binary")

    def run(batches):
        for batch in batches:
            vectors, ok = matrix(batch.column(1))
            signs: list = [None] * len(vectors)
            for size in {len(v) for v, good in zip(vectors, ok, strict=True) if good}:
                rows = [i for i in range(len(vectors)) if ok[i] and len(vectors[i]) == size]
                side = np.stack([vectors[i] / np.abs(vectors[i]).max() for i in rows]) @ planes(size, bits, tables) > 0
                packed = np.packbits(side, axis=1, bitorder="little")
                packed = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))
                for i, c in zip(rows, packed, strict=True):
                    signs[i] = c.tobytes()
            data = [v.astype(kind).tobytes() if good else None for v, good in zip(vectors, ok, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashlib.blake2b(d, digest_size=16).digest() if d else None for d in data], pa.binary()), pa.array(data, pa.binary()), pa.array(signs, pa.binary())], names=["key", "digest", "x", "signs"])

    return df.select(F.col(id_col), F.col(vector_col)).mapInArrow(run, schema)


def _unlike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def _met(code: np.ndarray, i: np.ndarray, j: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether pairs of rows met in a table before theirs."""
    out, number = np.zeros(len(i), bool), np.arange(code.shape[1])
    for at in range(0, len(i), 1 << 15):
        part = slice(at, at + (1 << 15))
        out[part] = ((code[i[part]] == code[j[part]]) & (number < table[part][:, None])).any(1)
    return out


def _pairs(signs: np.ndarray, edge: np.ndarray, side: np.ndarray, most: int):
    """Pairs of rows of one group each whose signs are alike; ``edge`` is where groups begin, and the end. Rows of two sides are
    compared across them."""
    end = np.repeat(edge[1:], np.diff(edge))
    at = np.flatnonzero(end - np.repeat(edge[:-1], np.diff(edge)) <= SMALL)
    for d in range(1, SMALL):
        at = at[at + d < end[at]]
        if not len(at):
            break
        near = (_unlike(signs[at], signs[at + d]) <= most) & ((side[at] != side[at + d]) | (side[edge[np.searchsorted(edge, at, "right") - 1]] == side[end[at] - 1]))
        yield at[near], at[near] + d
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if b - a > SMALL:
            cut = a + int(np.searchsorted(side[a:b], 1))
            two = a < cut < b
            for i in range(a, cut if two else b, 250):
                last = min(i + 250, cut if two else b)
                first = cut if two else i
                near = _unlike(signs[i:last, None], signs[None, first:b]) <= most
                x, y = np.nonzero(near)
                x, y = x + i, y + first
                yield (x, y) if two else (x[x < y], y[x < y])


def _candidates(rows: DataFrame, bits: int, tables: int, most: int) -> DataFrame:
    """Rows ``bucket, table, i, j, side, node, signs`` -> those, without signs, that are alike another of their bucket and pair of
    blocks which they have not met before."""
    kind = rows.select("bucket", "table", "i", "j", "side", "node").schema
    dealt = rows.select("bucket", "table", "i", "j", "side", "node", "signs").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "table", "i", "j", "side")

    def alike(held: pa.Table, whole: bool):
        """Rows of the groups that are complete, and where the last one begins, if it may go on."""
        key = [held.column(k).to_numpy() for k in range(4)]
        new = np.zeros(len(held), bool)
        new[:1] = True
        for k in key:
            new[1:] |= k[1:] != k[:-1]
        edge = np.append(np.flatnonzero(new), len(held))
        if not whole:
            edge = edge[:-1]
        n = int(edge[-1])
        signs = np.frombuffer(b"".join(held.column(6).slice(0, n).to_pylist()), np.uint64).reshape(n, -1) if n else np.zeros((0, 1), np.uint64)
        hit, code = np.zeros(n, bool), None
        for x, y in _pairs(signs, edge, held.column(4).to_numpy(), most) if n else ():
            if len(x):
                code = codes(signs, bits, tables) if code is None else code
                fresh = ~_met(code, x, y, key[1][x])
                hit[x[fresh]] = hit[y[fresh]] = True
        return held.slice(0, n).select(kind.names).filter(pa.array(hit)), n

    def run(batches):
        held = None
        for b in batches:
            b = pa.Table.from_batches([b])
            held = b if held is None else pa.concat_tables([held, b])
            if len(held) >= TOGETHER:
                out, n = alike(held, False)
                yield from out.to_batches()
                held = held.slice(n)
        if held is not None:
            yield from alike(held, True)[0].to_batches()

    return dealt.mapInArrow(run, kind)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of scaled rows, so that no product is beyond the range of doubles."""
    a, b = a / np.abs(a).max(1, keepdims=True), b / np.abs(b).max(1, keepdims=True)
    return (a @ b.T) / np.sqrt((a * a).sum(1))[:, None] / np.sqrt((b * b).sum(1))[None, :]


def links_within(table: int, a, b, least: float, bits: int, tables: int, kind: str):
    """``node, links, other`` rows of two lists of ``node, n, x, signs`` (one list twice: the pairs inside it). Lists are those of
    blocks, BLOCK rows and some more by chance."""
    same = a is b
    x = np.stack([np.frombuffer(r[2], kind) for r in a]).astype(np.float64)
    y = x if same else np.stack([np.frombuffer(r[2], kind) for r in b]).astype(np.float64)
    near = cosines(x, y) >= least
    if same:
        near |= near.T
        np.fill_diagonal(near, False)
    i, j = np.nonzero(near)
    if not len(i):
        return
    code = codes(np.frombuffer(b"".join(r[3] for r in (a if same else [*a, *b])), np.uint64).reshape(len(a) + (0 if same else len(b)), -1), bits, tables)
    earlier = _met(code, i, j + (0 if same else len(a)), np.full(len(i), table))
    i, j = i[~earlier], j[~earlier]
    if not len(i):
        return
    nodes = [r[0] for r in a] if same else [r[0] for r in a] + [r[0] for r in b]
    sizes = np.array([r[1] for r in a] if same else [r[1] for r in a] + [r[1] for r in b], np.int64)
    if not same:
        i, j = np.concatenate([i, j + len(a)]), np.concatenate([j + len(a), i])
    count = np.zeros(len(nodes), np.int64)
    np.add.at(count, i, sizes[j])
    # a spanning forest: every round links each tree to the least tree that it touches
    tree, edges = np.arange(len(nodes)), {}
    while True:
        low = tree.copy()
        np.minimum.at(low, tree[i], tree[j])
        moved = np.flatnonzero((tree[i] != tree[j]) & (tree[j] == low[tree[i]]))
        if not len(moved):
            break
        roots, first = np.unique(tree[i[moved]], return_index=True)
        for r, k in zip(roots.tolist(), moved[first].tolist(), strict=True):
            edges[r] = (nodes[i[k]], nodes[j[k]])
        while (low != low[low]).any():
            low = low[low]
        tree = low[tree]
    for k in np.flatnonzero(count).tolist():
        yield nodes[k], int(count[k]), None
    for u, v in edges.values():
        yield u, 0, v


def _bucket_links(rows: DataFrame, least: float, bits: int, tables: int, kind: str) -> DataFrame:
    """Rows ``bucket, table, i, j, side, node, n, x, signs`` dealt out by bucket and pair of blocks."""
    dealt = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def run(batches):
        out, group, key = [], ([], []), None

        def flush():
            if key is not None:
                table, i, j = key[1:]
                if i == j:
                    out.extend(links_within(table, group[0], group[0], least, bits, tables, kind) if len(group[0]) > 1 else ())
                elif group[0] and group[1]:
                    out.extend(links_within(table, group[0], group[1], least, bits, tables, kind))

        def batch():
            node, links, other = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (node, links, other)], names=["node", "links", "other"])

        for b in batches:
            for bucket, table, i, j, side, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (bucket, table, i, j) != key:
                    flush()
                    group, key = ([], []), (bucket, table, i, j)
                group[side].append(row)
            if len(out) > 10_000:
                yield batch()
                out.clear()
        flush()
        if out:
            yield batch()

    return dealt.mapInArrow(run, "node long, links long, other long")


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95) -> DataFrame:
    """``id_col, n_links, component_id, kept`` for each row: how many other rows have a cosine of ``least`` or more with
    it, the least id that links lead to, and whether it is this row's.

    Rows whose vector is null, empty or zero, or has a component that is null or not finite, link with nothing. Vectors of
    different sizes don't link. Repeated rows link with each other. A null id is never the least where there is another.
    A pair at the threshold is missed with a probability of 0.001, and one above it with less; no pair below it is linked."""
    spark = df.sparkSession
    limit_batches(spark)
    bits, tables = plan(df.count(), least)
    element = getattr(df.schema[vector_col].dataType, "elementType", None)
    kind = "<f4" if element is not None and element.simpleString() == "float" else "<f8"
    signed = written(_signed(df, id_col, vector_col, bits, tables, kind), "vectors-signed")
    nodes = signed.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n"), F.first("x").alias("x"), F.first("signs").alias("signs"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors-nodes")

    def keys(batches):
        for b in batches:
            if not len(b):
                continue
            packed = b.column(1).to_pylist()
            code = codes(np.frombuffer(b"".join(packed), np.uint64).reshape(len(packed), -1), bits, tables).astype(np.uint64)
            salt = np.arange(1, tables + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
            size = b.column(2).to_numpy().astype(np.uint64)
            # one number for table, size of the vector and signs; unlike ones that meet only cost time
            bucket = (code * np.uint64(0x9E3779B97F4A7C15) + salt + size[:, None]) >> np.uint64(1)
            table = np.tile(np.arange(tables, dtype=np.int32), len(packed))
            which = pa.array(np.repeat(np.arange(len(packed)), tables))
            yield pa.RecordBatch.from_arrays([b.column(0).take(which), pa.array(table), pa.array(bucket.ravel().view(np.int64)), b.column(1).take(which)], names=["node", "table", "bucket", "signs"])

    in_buckets = nodes.select("node", "signs", F.octet_length("x").alias("size")).mapInArrow(keys, "node long, table int, bucket long, signs binary")
    in_buckets = written(in_buckets, "vectors-buckets")
    large = written(in_buckets.groupBy("bucket", "table").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > BLOCK), "vectors-large")
    placed = in_buckets.join(large, ["bucket", "table"], "left").withColumn("blocks", F.ceil(F.coalesce("rows", F.lit(1)) / BLOCK).cast("int"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # each block meets every block of its bucket once: the pair (i, j), i at most j, has the row on the side of its block
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("bucket", "table", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "signs")
    alike = written(_candidates(placed, bits, tables, most_unlike(bits * tables, least)), "vectors-alike")
    release(in_buckets, large)
    rows = alike.join(nodes.select("node", "n", "x", "signs"), "node").select("bucket", "table", "i", "j", "side", "node", "n", "x", "signs")
    found = written(_bucket_links(rows, least, bits, tables, kind), "vectors-links")
    release(alike)
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    component = connected_components(found.where(F.col("other").isNotNull()).select(F.col("node").alias("u"), F.col("other").alias("v")))
    facts = nodes.select("node", "digest", "first", "n").join(counts, "node", "left").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least_id = facts.groupBy("component").agg(F.min("first").alias("component_id"))
    facts = written(facts.join(least_id, "component").select("digest", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id", F.lit(True).alias("known")), "vectors-facts")
    release(nodes, found, component)
    out = signed.select("key", "digest").join(facts, "digest", "left")
    component_id = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("key"))
    return out.select(F.col("key").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id")).withColumn("kept", F.col("component_id").eqNullSafe(F.col(id_col)))
