"""Connected components of a distributed list of links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import limit_batches, release, written

#: Links that a task takes at first; some 100 bytes of memory each.
TASK_LINKS = 1_000_000


def _least(links: DataFrame) -> DataFrame:
    """``u`` and the least of it and its neighbours."""
    return links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _forest(batches):
    """``u, v`` of a task's own links -> each of its nodes with the least node of its component there."""
    columns = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    u, v = (np.concatenate([c[k] for c in columns]) if columns else np.zeros(0, np.int64) for k in (0, 1))
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = root.copy()
        np.minimum.at(low, root[a], root[b])
        np.minimum.at(low, root[b], root[a])
        while (low != low[low]).any():
            low = low[low]
        if (low[root] == root).all():
            break
        root = low[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["u", "v"])


def connected_components(links: DataFrame) -> DataFrame:
    """``u, v`` links -> ``node, component``, the least node of its component; nodes without links aren't in it.

    Tasks first reduce TASK_LINKS links each to stars of their own components; if that was one task, it is the result.
    Stars of several tasks are joined by two steps in turn until nothing changes: every node links its larger
    neighbours to the least node that it sees, then itself and its smaller neighbours to it. Both are a
    pre-aggregated minimum and a join that Spark can split, so a node with very many links isn't gathered anywhere. Links
    may repeat, point either way, or join a node to itself; null ends are left out. The number of rounds grows with the
    logarithm of the longest path."""
    limit_batches(links.sparkSession)
    given = written(links.where("u is not null and v is not null and u != v").select("u", "v"), "links")
    tasks = max(1, -(-given.count() // TASK_LINKS))
    stars = written(given.coalesce(tasks).mapInArrow(_forest, "u long, v long"), "components")
    release(given)
    if tasks == 1:
        return _named(stars, stars.select(F.col("u").alias("node"), F.col("v").alias("component")))
    links, last, before = stars.where("u != v"), stars, None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.where("v > u").join(_least(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = written(large, "links")
        release(last)
        least = _least(large)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        links = last = written(small, "links")
        release(large)
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = written(links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), "components")
    release(last)
    return out


def _named(table: DataFrame, columns: DataFrame) -> DataFrame:
    """``columns`` of a written table, which ``release`` takes as the table."""
    columns._colframe_folder = table._colframe_folder
    return columns
