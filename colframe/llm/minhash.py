"""Near-duplicate documents by weighted minhash signatures (operator 8).

A text is the multiset of its five-word shingles. A shingle of weight c owns the weight axis from 0 to c, which is
cut at 1, 2, 4, 8 and so on; each part has a Poisson process of its own, with a rate as large as the part, and each of
its points has a place on the axis, a register and a time. What lies below c counts. A register keeps its
earliest point; two texts share it with a probability equal to their weighted Jaccard similarity. Points come in
the order of time and are needed only up to the time at which all registers are filled, so large weights and long
texts cost little.

Texts that share a band of registers are verified by the overlap of their multisets. Equal texts are one node.
In a band's group, all are verified against one of them; what this leaves in different components is verified
against another, and at last components against each other, so no link that would join them is lost.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .shingles import mixed, shingles
from .store import Beside, gives_back, limit_batches, numbered, release, utf8, written

#: A pair of similarity 0.8 shares none of 24 bands of 4 registers with a probability of 3 in a million.
BANDS, ROWS = 24, 4
#: Rounds of verifying against one member of each group, before components are compared with each other.
PIVOT_ROUNDS = 2
#: Nodes of a block in the last round; a task compares two blocks.
CROSS_BLOCK = 256
#: Texts, in bytes, whose signatures are made at once.
BLOCK = 1 << 20


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(text: np.ndarray, hashes: np.ndarray, counts: np.ndarray, n_texts: int, m: int = BANDS * ROWS) -> np.ndarray:
    """An array of ``m`` 64-bit registers for each text; those of a text without shingles are 0."""
    weight = np.bincount(text, counts, n_texts)
    out = np.zeros((n_texts, m), np.uint64)
    todo, slack = weight > 0, np.log(m) + 5.0
    while todo.any():
        horizon = np.where(todo, m * slack / np.maximum(weight, 1), -1.0)
        first, value = np.full(n_texts * m, np.inf), np.zeros(n_texts * m, np.uint64)
        level = 0
        keep = todo[text]
        t, h, c = text[keep], hashes[keep], counts[keep]
        while len(t):
            low, rate = (0, 1) if level == 0 else (1 << (level - 1), 1 << (level - 1))
            above = c > low
            t, h, c = t[above], h[above], c[above]
            _points(t, mixed(h + np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)), c - low, rate, horizon, m, first, value)
            level += 1
        first, value = first.reshape(n_texts, m), value.reshape(n_texts, m)
        full = todo & np.isfinite(first).all(1)
        out[full] = value[full]
        todo &= ~full
        slack *= 3
    return out


def _points(text, seed, covered, rate, horizon, m, first, value) -> None:
    """Points of one part of the axis, of all shingles, up to their texts' horizons."""
    time, step = np.zeros(len(text)), 0
    while len(text):
        x = mixed(seed + np.uint64(step * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log(_uniform(x)) / rate
        on = time <= horizon[text]
        text, seed, covered, time, x = text[on], seed[on], covered[on], time[on], x[on]
        y = mixed(x)
        inside = slice(None) if rate == 1 else (y >> np.uint64(32)).astype(np.float64) * 2.0**-32 * rate < covered
        place = text[inside] * m + (y[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64) % m
        when = time[inside]
        before = first[place]
        np.minimum.at(first, place, when)
        won = (when == first[place]) & (when < before)
        value[place[won]] = y[inside][won]
        step += 1


def band_hashes(sigs: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit hash of each band, which tells bands apart."""
    parts = sigs.reshape(len(sigs), bands, -1)
    h = np.broadcast_to(np.arange(bands, dtype=np.uint64) + np.uint64(1), parts.shape[:2]).copy()
    for k in range(parts.shape[2]):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return h.view(np.int64)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets given as sorted hashes and counts."""
    _, i, j = np.intersect1d(a[0], b[0], True, True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    total = int(a[1].sum() + b[1].sum()) - both
    return both / total if total else 0.0


def word_digest(text: bytes) -> bytes:
    """Equal for texts of equal words."""
    return hashlib.blake2b(b" ".join(text.split()), digest_size=16).digest()


def _blocks(texts: list[bytes]):
    block, size = [], 0
    for i, t in enumerate(texts):
        if block and size + len(t) > BLOCK:
            yield block
            block, size = [], 0
        block.append(i)
        size += len(t)
    if block:
        yield block


def _signed(rows: DataFrame, n: int) -> DataFrame:
    """``row, key, digest, weight, bands`` of each row; a text without words has null bands."""
    schema = rows.select("row", "key").schema.add("digest", "binary").add("weight", "long").add("bands", T.ArrayType(T.LongType()))

    def run(batches):
        for batch in batches:
            texts, digests, weights, bands = utf8(batch.column(2)), [], [], []
            for block in _blocks(texts):
                some = [texts[i] for i in block]
                text, h, c = shingles(some, n)
                weight = np.bincount(text, c, len(some)).astype(np.int64)
                hashes = band_hashes(signatures(text, h, c, len(some)))
                digests += [word_digest(t) for t in some]
                weights += weight.tolist()
                bands += [x if w else None for x, w in zip(hashes, weight, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(weights, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["row", "key", "digest", "weight", "bands"])

    return rows.select("row", "key", "text").mapInArrow(gives_back(run), schema)


def _contents(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, z``: the compressed texts of the rows whose numbers are in ``wanted``, taken where the rows are."""
    beside = Beside(wanted.select(F.col("node").alias("row")), "minhash-wanted")

    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=1)
        for batch, _, lo, hi in beside.merged(batches, []):
            found = batch.filter(pa.array(lo < hi))
            yield pa.RecordBatch.from_arrays([found.column(0), pa.array([pack.compress(t) for t in utf8(found.column(1))], pa.binary())], names=["node", "z"])

    out = written(rows.select("row", "text").mapInArrow(gives_back(run), "node long, z binary"), "minhash-contents")
    beside.release()
    return out


def verified(pairs: DataFrame, contents: DataFrame, n: int, least: float) -> DataFrame:
    """The ``a, b`` pairs of nodes whose similarity is ``least`` or more. ``contents``: ``node, z``."""

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            a, b, za, zb = (c.to_pylist() for c in batch.columns)
            packed = dict(zip(a, za, strict=True)) | dict(zip(b, zb, strict=True))
            nodes, sets = list(packed), {}
            texts = [unpack.decompress(packed[x]) for x in nodes]
            for block in _blocks(texts):
                text, h, c = shingles([texts[i] for i in block], n)
                edge = np.searchsorted(text, np.arange(len(block) + 1))
                for k, i in enumerate(block):
                    hs, cs = h[edge[k] : edge[k + 1]], c[edge[k] : edge[k + 1]]
                    order = np.argsort(hs)
                    sets[nodes[i]] = (hs[order], cs[order])
            good = [overlap(sets[x], sets[y]) >= least for x, y in zip(a, b, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = contents.select(F.col("node").alias("a"), F.col("z").alias("za"))
    right = contents.select(F.col("node").alias("b"), F.col("z").alias("zb"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "za", "zb").mapInArrow(gives_back(run), "a long, b long")


def cross_links(members: DataFrame, contents: DataFrame, n: int, least: float) -> DataFrame:
    """Links between components among ``band, node, component, p`` rows whose bands join different ones.

    Bands chain nodes to clusters. All of a cluster but its largest component is compared with all of it: blocks of the
    former with blocks of the latter, two blocks of about CROSS_BLOCK nodes in a task at a time, so a node is sent as
    often as the other side has blocks. A task gives links that join components and no others. Pairs are compared by their
    signatures first, and those that may be similar by their multisets."""
    clusters = connected_components(members.select(F.col("node").alias("u"), F.col("p.node").alias("v")))
    nodes = written(members.select("node", "component").distinct().join(clusters.withColumnRenamed("component", "cluster"), "node"), "minhash-clusters")
    sizes = nodes.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n"))
    sizes = written(sizes.groupBy("cluster").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("top")), "minhash-sizes")
    blocks = {0: F.col("n"), 1: F.col("n") - F.col("top.n")}
    blocks = {side: F.ceil(k / CROSS_BLOCK).cast("int") for side, k in blocks.items()}
    placed = nodes.join(sizes, "cluster")

    def dealt(side: int) -> DataFrame:
        own = F.pmod(F.xxhash64("node"), blocks[side]).cast("int")
        other = F.explode(F.sequence(F.lit(0), blocks[1 - side] - 1))
        rows = placed.where("component != top.component") if side else placed.where("n > top.n")
        rows = rows.select("cluster", own.alias("own"), other.alias("other"), F.lit(side).alias("side"), "node", "component")
        return rows.select("cluster", F.col("other" if side else "own").alias("i"), F.col("own" if side else "other").alias("j"), "side", "node", "component")

    rows = dealt(0).unionByName(dealt(1)).join(contents, "node").select("cluster", "i", "j", "side", "node", "component", "z").repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        key, group = None, []

        def flush():
            links = _cross(group, unpack, n, least) if group else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], schema=schema)

        for batch in batches:
            for cluster, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (cluster, i, j) != key:
                    yield flush()
                    key, group = (cluster, i, j), []
                group.append(row)
        yield flush()

    found = written(rows.mapInArrow(gives_back(run), "a long, b long"), "minhash-links")
    release(nodes, sizes, clusters)
    return found


def _cross(group: list, unpack, n: int, least: float) -> list[tuple[int, int]]:
    """Links between components of ``side, node, component, z`` rows, from side 1 to side 0, a spanning set of them. The
    rows are those of two blocks."""
    if not any(r[0] == 0 for r in group) or not any(r[0] == 1 for r in group):
        return []
    unique = {node: (component, z) for _, node, component, z in group}
    nodes = list(unique)
    place = {x: i for i, x in enumerate(nodes)}
    texts = [unpack.decompress(unique[x][1]) for x in nodes]
    sets, sigs, weight = [], [], []
    for block in _blocks(texts):
        some = [texts[i] for i in block]
        text, h, c = shingles(some, n)
        edge = np.searchsorted(text, np.arange(len(block) + 1))
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            order = np.argsort(h[a:b])
            sets.append((h[a:b][order], c[a:b][order]))
        sigs.append(signatures(text, h, c, len(some)))
        weight.append(np.bincount(text, c, len(some)))
    sigs, weight = np.concatenate(sigs), np.concatenate(weight)
    root = {unique[x][0]: unique[x][0] for x in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    left = np.array(sorted({place[r[1]] for r in group if r[0] == 0}))
    out = []
    for i in sorted({place[r[1]] for r in group if r[0] == 1}):
        # five deviations below the threshold: a similar pair is passed over with a probability of 3 in ten millions
        alike = (sigs[left] == sigs[i]).mean(1) >= least - 5 * np.sqrt(least * (1 - least) / sigs.shape[1])
        near = np.minimum(weight[left], weight[i]) >= least * np.maximum(weight[left], weight[i])
        for j in left[alike & near].tolist():
            a, b = find(unique[nodes[i]][0]), find(unique[nodes[j]][0])
            if a != b and overlap(sets[i], sets[j]) >= least:
                root[a] = b
                out.append((nodes[i], nodes[j]))
    return out


def classes(rows: DataFrame, n: int = 5, least: float = 0.8) -> DataFrame:
    """``row, key, best`` of each of the ``row, key, text`` rows that ``numbered`` wrote: ``best`` holds the least key, nulls
    last, and then the least row (``last, key, row``) among the texts that links of similarity ``least`` or more lead to.

    Texts without words link with nothing, each row being its own class. Texts of equal words are one node."""
    limit_batches(rows.sparkSession)
    signed = written(_signed(rows, n), "minhash-signed")
    own = F.struct(F.col("key").isNull().alias("last"), "key", "row")
    nodes = signed.where(F.col("bands").isNotNull()).groupBy("digest").agg(F.min("row").alias("node"), F.min(own).alias("first"), F.first("weight").alias("weight"), F.first("bands").alias("bands"))
    nodes = written(nodes, "minhash-nodes")
    in_bands = nodes.select("node", "weight", F.explode("bands").alias("band"))
    shared = in_bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band")
    members = written(in_bands.join(shared, "band"), "minhash-members")
    contents = _contents(rows, members.select("node").distinct())

    links, component, no_component = None, None, nodes.select("node", F.col("node").alias("component")).limit(0)
    for round_ in range(PIVOT_ROUNDS + 1):
        # what groups still hold in different components; the others have nothing to add
        placed = members.select("band", "node", "weight").join(no_component if component is None else component, "node", "left").withColumn("component", F.coalesce("component", "node"))
        open_ = placed.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min(F.struct(F.xxhash64("node", F.lit(round_)), "node", "weight", "component")).alias("p")).where("x != y")
        open_ = written(open_.select("band", "p"), "minhash-open")  # a table of its own, so that Spark can split a band of many nodes
        left = written(placed.join(open_, "band"), "minhash-members")
        release(members, open_)
        members = left
        if members.isEmpty():
            break
        if round_ < PIVOT_ROUNDS:
            pairs = members.where("component != p.component").select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b"), "weight", F.col("p.weight").alias("weight_b"))
            pairs = pairs.where(F.least("weight", "weight_b") >= least * F.greatest("weight", "weight_b")).select("a", "b").distinct()
            found = written(verified(pairs, contents, n, least), "minhash-links")
        else:
            found = cross_links(members, contents, n, least)
        if not found.isEmpty():
            # what is known of components is all that later rounds need of the links
            new = found.select(F.col("a").alias("u"), F.col("b").alias("v"))
            before, component = component, connected_components(new if links is None else links.unionByName(new))
            links = component.select(F.col("node").alias("u"), F.col("component").alias("v"))
            release(before)
        release(found)
    release(members, contents)
    known = nodes.join(no_component if component is None else component, "node", "left").withColumn("component", F.coalesce("component", "node")).select("digest", "component", "first")
    best = known.groupBy("component").agg(F.min("first").alias("best"))
    by_digest = written(known.join(best, "component").select("digest", "best"), "minhash-classes")
    out = signed.select("row", "key", "digest").join(by_digest, "digest", "left")
    out = written(out.select("row", "key", F.coalesce("best", own).alias("best")), "minhash-rows")
    release(signed, nodes, component, by_digest)
    return out


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, least: float = 0.8) -> DataFrame:
    """``id_col, class_id, kept`` for each row: the least id among the texts that links of similarity ``least`` or
    more lead to, and whether it is this row's.

    Texts without words link with nothing, each being its own class. Rows of one id and equal words are one document.
    A null id is never the least one of a class that has another. An empty table gives an empty result."""
    rows = numbered(df.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text")), "minhash-texts")
    out = classes(rows, n, least)
    release(rows)
    return out.select(F.col("key").alias(id_col), F.col("best.key").alias("class_id")).withColumn("kept", F.col("class_id").eqNullSafe(F.col(id_col)))
