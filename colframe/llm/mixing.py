"""Mixing sources to target weights by nested hash thresholds (operator 1); DataFrame operations only.

Every row has a hash of its id. A source takes each of its rows a whole number of times, and once more those
whose hash lies below a threshold. Thresholds come from histograms: words are summed by source and by the
first hex digits of the hash, and only the one bucket in which a source's budget ends is looked at with more
digits, until it holds one hash. Nothing is sorted, and a hot source is summed before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

#: A word is a run of characters that aren't ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the hash that one histogram adds, of 32.
DIGITS = 3
#: Sources up to which their thresholds are broadcast (a row of some 100 bytes each); beyond, they are joined.
BROADCAST_SOURCES = 20_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(key: Column) -> Column:
    return F.md5(F.coalesce(key.cast("string"), F.lit("")))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], budget: float, cap: float) -> DataFrame:
    """``source, size`` -> with ``target``: shares by weight of ``budget`` times the total, none above ``cap``
    times its source's size.

    Sources are put in the order in which they fill up as all shares grow; those before the first that never
    does stop at their caps, and the rest share by weight what is left. One row for each source."""
    by_name, all_rows = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    order = Window.orderBy(F.col("full") / F.col("w"), F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.lit(budget) * F.sum("size").over(all_rows) - F.coalesce(F.sum("full").over(before), F.lit(0.0))
    level = F.when(F.col("full") > F.col("w") * F.col("level"), F.col("level"))
    return (
        sizes.withColumn("w", w).withColumn("full", F.lit(cap) * F.col("size"))
        .withColumn("level", left / F.sum("w").over(rest))
        .withColumn("level", F.max(level).over(all_rows))
        .select("source", F.col("size").alias("source_size"), F.least(F.col("full"), F.coalesce(F.col("w") * F.col("level"), F.col("full"))).alias("target"))
    )


def joined(df: DataFrame, bounds: DataFrame, n_sources: int) -> DataFrame:
    """Each row with its source's bounds: broadcast up to a number of sources, else a join that Spark may split."""
    right = bounds.withColumnRenamed("source", "of_source")
    on = F.col("source").eqNullSafe(F.col("of_source"))
    return df.join(F.broadcast(right) if n_sources <= BROADCAST_SOURCES else right, on).drop("of_source")


def mix_bounds(sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), budget: float = 1.5, cap: float = 2.0) -> tuple[DataFrame, int]:
    """``source, size, hash`` rows -> one row for each source: ``source_size, target, whole, last_hash, last_in``.

    A row of the source is taken ``whole`` times, and once more if its hash is below ``last_hash``, or equal to
    it where ``last_in``: the cut is the one nearest to the target. Also returns the number of sources."""
    sizes = written(sized.groupBy("source").agg(F.sum("size").alias("size")), "mix-sizes")
    n = sizes.count()
    whole = F.floor(F.least(F.col("target") / F.col("source_size"), F.lit(cap - 1)))
    state = source_targets(sizes, weights, budget, cap).withColumn("whole", F.when(F.col("source_size") > 0, whole).otherwise(0).cast("long"))
    state = state.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("before", F.lit(0).cast("long"))
    state = written(state.withColumn("prefix", F.lit("")).withColumn("one", F.lit(False)).withColumn("words", F.lit(0).cast("long")), "mix-level0")
    for digits in range(DIGITS, 32 + DIGITS, DIGITS):
        part = joined(sized, state.where(~F.col("one")), n).where(F.col("hash").startswith(F.col("prefix")))
        part = part.groupBy("source", F.substring("hash", 1, digits).alias("bucket")).agg(F.sum("size").alias("sum"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        part = joined(part.withColumn("upto", F.sum("sum").over(upto)), state, n).withColumn("upto", F.col("upto") + F.col("before"))
        ends = part.where(F.col("upto") > F.col("rest")).groupBy("source").agg(F.min(F.struct("bucket", "upto", "sum", "low", "high")).alias("b"))
        ends = state.join(ends.withColumnRenamed("source", "of_source"), F.col("source").eqNullSafe(F.col("of_source")), "left").drop("of_source")
        open_, b = ~F.col("one"), F.col("b")
        state = written(
            ends.select(
                "source", "source_size", "target", "whole", "rest",
                F.when(open_ & b.isNotNull(), b["upto"] - b["sum"]).otherwise(F.col("before")).alias("before"),
                # no bucket goes beyond the rest: all are taken ("g" is above every hex digit)
                F.when(~open_, F.col("prefix")).when(b.isNull(), F.lit("g")).when(b["low"] == b["high"], b["low"]).otherwise(b["bucket"]).alias("prefix"),
                (~open_ | b.isNull() | (b["low"] == b["high"])).alias("one"),
                F.when(open_ & b.isNotNull(), b["sum"]).otherwise(F.col("words")).alias("words"),
            ),
            "mix-level",
        )
        if state.where(~F.col("one")).isEmpty():
            break
    last_in = 2 * F.col("before") + F.col("words") <= 2 * F.col("rest")
    return state.select("source", "source_size", "target", "whole", F.col("prefix").alias("last_hash"), last_in.alias("last_in")), n


def with_copies(df: DataFrame, bounds: DataFrame, n_sources: int) -> DataFrame:
    """``df`` (with ``source`` and ``hash``) with its source's bounds and ``copies``, how often a row is taken."""
    more = (F.col("hash") < F.col("last_hash")) | (F.col("last_in") & (F.col("hash") == F.col("last_hash")))
    return joined(df, bounds, n_sources).withColumn("copies", F.col("whole") + more.cast("long"))


def mix(df: DataFrame, weights: tuple[float, ...] = (3, 1, 2), budget: float = 1.5, cap: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``id_col, source, size, source_size, target, copies, taken`` for each row of ``df``.

    Sources in code point order, null as a source of its own after the others, weigh ``weights`` in turn and share
    ``budget`` times all words; a target stops at ``cap`` times its source's words, and what is above is shared
    again by weight. Rows whose ids are equal (null ids too) are taken alike, so a cut doesn't fall between them.
    A null text has no words. An empty table gives an empty result."""
    sized = written(df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), row_hash(F.col(id_col)).alias("hash")), "mix-sized")
    bounds, n = mix_bounds(sized.select("source", "size", "hash"), weights, budget, cap)
    out = with_copies(sized, bounds, n)
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def apply_mix(df: DataFrame, weights: tuple[float, ...] = (3, 1, 2), budget: float = 1.5, cap: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``df`` as the mix takes them: not at all, once, or repeated."""
    names = df.columns
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(source_col).cast("string").alias("source"), row_hash(F.col(id_col)).alias("hash"))
    sized = written(df.select(F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), row_hash(F.col(id_col)).alias("hash")), "mix-sized")
    bounds, n = mix_bounds(sized, weights, budget, cap)
    taken = with_copies(packed, bounds, n).where(F.col("copies") > 0)
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
