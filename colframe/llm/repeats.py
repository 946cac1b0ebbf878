"""Repeated byte strings of a corpus, by prefix-free parsing (operator 4).

A rolling hash over ``w`` bytes triggers phrases: a place is a trigger if its hash is the least of some stretch of
places as long as a string of ``least`` bytes has. So every such string holds a trigger, at a place that its own bytes
decide: its occurrences are parsed alike, whatever stands around them. The strings that belong to one trigger start in one
stretch; a phrase is a stretch with all bytes of its strings. The dictionary is the distinct phrases; what it holds of a phrase
that occurs more than once is repeated. Other phrases can share strings only with phrases of the same trigger, so the triggers
part the dictionary into shares, and each share is put into corpus order by the suffix arrays of its own dictionary and parse
(``suffixes``). Neighbours in that order that agree in ``least`` bytes are repeated.

A trigger with very many distinct phrases (boilerplate that all kinds of text surround) is split first: its phrases are cut
into blocks of starts, which share a finer trigger only if the bytes agree that all strings of a block have in common; equal blocks are one
entry again, and only triggers that still have many are cut into smaller blocks, at last start by start, when counts alone decide.

Texts stay where they were numbered and written; what is known of them (copies, repeated triggers, spans) is sorted by
number and read beside them.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import suffixes
from .shingles import mixed
from .store import Beside, gives_back, limit_batches, numbered, release, utf8, written

#: Bytes of one round of array operations; local places fit into PLACE_BITS bits.
PLACE_BITS = 18
PIECE = 1 << PLACE_BITS
#: Distinct phrases of a trigger that are ordered in one task; one with more is split into blocks of so many starts.
PHRASES, STEPS = 256, (32, 4, 1)
#: Bytes of phrases whose suffixes are ordered at once.
SHARE = 1 << 20

SPANS = "array<struct<lo:int,hi:int>>"


@lru_cache(maxsize=1)
def _tables() -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each of two sums: powers of an odd number modulo 2^64, their inverses, a random value of each byte."""
    values = np.random.default_rng(4).integers(0, 1 << 64, (2, 256), np.uint64)
    out = []
    for base, v in zip((0xA24BAED4963EE407, 0x9FB21C651E98DF25), values, strict=True):
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(PIECE + 1, b, np.uint64)
            x[0] = 1
            pair.append(np.multiply.accumulate(x))
        out.append((*pair, v))
    return out


class Sums:
    """128-bit sums of any stretches of some bytes, which don't depend on where they stand."""

    def __init__(self, data: np.ndarray, both: bool = True):
        self.of = []
        for powers, inverses, values in _tables()[: 2 if both else 1]:
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(values[data] * powers[: len(data)], out=total[1:])
            self.of.append((total, inverses))

    def __call__(self, which: int, a, b) -> np.ndarray:
        total, inverses = self.of[which]
        return (total[b] - total[a]) * inverses[a]


def pieces(texts: list[bytes], least: int):
    """Groups of ``(text, offset, bytes)`` of less than PIECE bytes; pieces of a longer text overlap so that each
    string of ``least`` bytes is in one of them."""
    group, size = [], 0
    for i, text in enumerate(texts):
        at = 0
        while at == 0 or at + least <= len(text):
            part = text[at : at + PIECE - 1]
            if size + len(part) >= PIECE:
                yield group
                group, size = [], 0
            group.append((i, at, part))
            size += len(part)
            at += len(part) - least + 1 if len(part) == PIECE - 1 else len(text) + 1
    if group:
        yield group


def stretches(group, least: int, w: int, full: bool):
    """Columns ``piece, t, lo, hi, g`` and with ``full`` ``k1, k2`` of the stretches of starts that share a trigger; places
    are local to the group's bytes."""
    data = np.frombuffer(b"".join(p for _, _, p in group), np.uint8)
    span, n = least - w + 1, len(data) - w + 1
    if len(data) < least:
        return None
    sums = Sums(data, full)
    at = np.arange(n)
    gram = mixed((sums.of[0][0][w:] - sums.of[0][0][:n]) * sums.of[0][1][:n])
    low = np.uint64(PIECE - 1)
    key = (gram & ~low) | (low - at.astype(np.uint64))  # of equal hashes, the last place comes first
    pad = -n % span
    table = np.concatenate([key, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, span)
    before = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = len(data) - least + 1
    chosen = (low - (np.minimum(behind[:starts], before[span - 1 : span - 1 + starts]) & low)).astype(np.int64)
    ends = np.cumsum([len(p) for _, _, p in group])
    inside = np.zeros(starts + 1, np.int64)  # starts whose string ends inside its piece
    first = ends - [len(p) for _, _, p in group]
    ok = ends - first >= least
    np.add.at(inside, first[ok], 1)
    np.add.at(inside, (ends - least + 1)[ok], -1)
    chosen[np.cumsum(inside[:-1]) == 0] = -1
    edge = np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1]))
    lo, hi, t = edge, np.append(edge[1:], starts) - 1, chosen[edge]
    keep = t >= 0
    lo, hi, t = lo[keep], hi[keep], t[keep]
    out = [np.searchsorted(ends, lo, "right"), t, lo, hi, gram[t]]
    if full:
        form = mixed((hi - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (t - lo).astype(np.uint64))
        out += [mixed(sums(0, lo, hi + least) + form), mixed(sums(1, lo, hi + least) ^ form)]
    return out


def _copies(rows: DataFrame, least: int) -> DataFrame:
    """``row, one, n_bytes`` of the texts of ``least`` bytes or more that are in the table more than once; ``one`` is the first of them."""
    text = F.col("text").cast("binary")
    keys = rows.where(F.octet_length("text") >= least).select("row", F.octet_length("text").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("sha"))
    keys = written(keys, "repeats-keys")
    many = written(keys.groupBy("sha").agg(F.min("row").alias("one"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "one"), "repeats-copied")
    out = written(keys.join(many, "sha").select("row", "one", "n_bytes"), "repeats-copies")
    release(keys, many)
    return out


def _triggers(rows: DataFrame, copies: Beside, least: int, w: int) -> DataFrame:
    """``row, g, n``: the triggers of each text, of copies those of the first, and whether they are there once (1) or more often (2)."""

    def run(batches):
        for batch, _, lo, hi in copies.merged(batches, []):
            batch = batch.filter(pa.array(lo == hi))
            texts, numbers = utf8(batch.column(1)), batch.column(0).to_numpy()
            for group in pieces(texts, least):
                s = stretches(group, least, w, False)
                if s is not None:
                    row = numbers[np.array([i for i, _, _ in group])[s[0]]]
                    order = np.lexsort((s[4], row))
                    row, g = row[order], s[4][order]
                    new = np.append(True, (row[1:] != row[:-1]) | (g[1:] != g[:-1]))
                    n = np.diff(np.append(np.flatnonzero(new), len(row)))
                    yield pa.RecordBatch.from_arrays([pa.array(row[new]), pa.array(g[new].view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int8))], names=["row", "g", "n"])

    return rows.select("row", "text").mapInArrow(gives_back(run), "row long, g long, n byte")


def _stretches(rows: DataFrame, hits: Beside, least: int, w: int) -> DataFrame:
    """``row, g, k1, k2, t, lo, hi``: the stretches of each text whose triggers ``hits`` has beside it."""

    def run(batches):
        names = ["row", "g", "k1", "k2", "t", "lo", "hi"]
        for batch, facts, lo, hi in hits.merged(batches, ["g"]):
            batch = batch.filter(pa.array(lo < hi))
            if not len(batch):
                continue
            texts, numbers = utf8(batch.column(1)), batch.column(0).to_numpy()
            known = facts.column("g").to_numpy().view(np.uint64)
            spans = list(zip(lo[lo < hi].tolist(), hi[lo < hi].tolist(), strict=True))
            for group in pieces(texts, least):
                s = stretches(group, least, w, True)
                if s is None:
                    continue
                piece, t, a, b, g, k1, k2 = s
                of = np.array([i for i, _, _ in group])
                hit, edge = np.zeros(len(g), bool), np.searchsorted(piece, np.arange(len(group) + 1))
                for p, i in enumerate(of.tolist()):
                    own = slice(edge[p], edge[p + 1])
                    hit[own] = np.isin(g[own], known[slice(*spans[i])])
                piece, t, a, b, g, k1, k2 = (x[hit] for x in (piece, t, a, b, g, k1, k2))
                ahead = (np.array([o for _, o, _ in group]) - np.cumsum([0, *(len(p) for _, _, p in group)])[:-1])[piece]
                yield pa.RecordBatch.from_arrays([pa.array(numbers[of[piece]]), *(pa.array(x.view(np.int64)) for x in (g, k1, k2)), *(pa.array((x + ahead).astype(np.int32)) for x in (t, a, b))], names=names)

    return rows.select("row", "text").mapInArrow(gives_back(run), "row long, g long, k1 long, k2 long, t int, lo int, hi int")


def _compared(rows: DataFrame, least: int, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """``row, g, k1, k2, t, lo, hi`` -> the covered ``row, lo, hi`` of stretches that occur more than once, and what has
    to be compared in finer parts: one stretch of each class whose ``g`` also has a class that occurs once, with the
    number of classes of that ``g``."""
    count = F.count(F.lit(1)).alias("n")
    if last:
        classes = written(rows.groupBy("g", "k1", "k2").agg(count), "repeats-classes")
    else:
        classes = written(rows.groupBy("g", "k1", "k2").agg(count, F.min(F.struct("row", "t", "lo", "hi")).alias("one")), "repeats-classes")
    many = classes.where("n > 1").select("g", "k1", "k2")
    covered = written(rows.join(many, ["g", "k1", "k2"]).select("row", "lo", (F.col("hi") + least).alias("hi")), "repeats-covered")
    open_ = None
    if not last:
        # a table of its own, so that Spark can split a trigger of many classes
        some = written(classes.groupBy("g").agg(F.count(F.lit(1)).alias("classes"), F.min("n").alias("n")).where("classes > 1 and n = 1").select("g", "classes"), "repeats-mixed")
        open_ = written(classes.join(some, "g").select("g", "classes", "one.*"), "repeats-open")
        release(some)
    release(classes)
    return covered, open_


def _split(rows: DataFrame, open_: Beside, least: int, step: int) -> DataFrame:
    """The parts of ``step`` starts of the stretches, counted from their triggers, with sums of their bytes. Parts have one
    ``g`` if they hang on one trigger, at one distance, and have the bytes in common that all strings of such a part
    have: without that, no string of theirs can be the same."""

    def run(batches):
        for batch, facts, begin, end in open_.merged(batches, ["g", "t", "lo", "hi"]):
            held = np.flatnonzero(begin < end)
            if not len(held):
                continue
            columns = [facts.column(k).to_numpy() for k in ("g", "t", "lo", "hi")]
            texts = utf8(batch.column(1).take(pa.array(held)))
            for i, data in zip(held.tolist(), texts, strict=True):
                text, number = np.frombuffer(data, np.uint8), batch.column(0)[i].as_py()
                g, t, lo, hi = (c[begin[i] : end[i]] for c in columns)
                order = np.argsort(lo, kind="stable")
                g, t, lo, hi = g[order].view(np.uint64), t[order].astype(np.int64), lo[order].astype(np.int64), hi[order].astype(np.int64)
                at = 0
                while at < len(lo):  # a long text piece by piece
                    base = lo[at]
                    n = max(1, int(np.searchsorted(np.maximum.accumulate(hi[at:]), base + PIECE - least - 1)))
                    part = slice(at, at + n)
                    yield _parts(text[base : base + PIECE], base, number, g[part], t[part], lo[part], hi[part], least, step)
                    at += n

    return rows.select("row", "text").mapInArrow(gives_back(run), "row long, g long, k1 long, k2 long, t int, lo int, hi int")


def _parts(data, base, row, g, t, lo, hi, least, step) -> pa.RecordBatch:
    sums = Sums(data)
    first, last = (t - hi) // step, (t - lo) // step
    number = last - first + 1
    of = np.repeat(np.arange(len(t)), number)
    block = first[of] + np.arange(len(of)) - (np.cumsum(number) - number)[of]
    t, a, b = t[of], np.maximum(lo[of], t[of] - block * step - step + 1), np.minimum(hi[of], t[of] - block * step)
    form = mixed((b - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (t - a).astype(np.uint64))
    x, y = a - base, b - base + least
    core = t - block * step - base
    common = sums(0, core, core - step + 1 + least)
    columns = [np.full(len(of), row, np.int64), mixed(g[of] + mixed(block.astype(np.uint64) + np.uint64(step << 32)) + mixed(common)), mixed(sums(0, x, y) + form), mixed(sums(1, x, y) ^ form)]
    return pa.RecordBatch.from_arrays([*(pa.array(c.view(np.int64)) for c in columns), *(pa.array(c.astype(np.int32)) for c in (t, a, b))], names=["row", "g", "k1", "k2", "t", "lo", "hi"])


def _ordered(rows: DataFrame, open_: Beside, least: int) -> DataFrame:
    """The covered ``row, lo, hi`` of the open stretches: phrases of one trigger come to one task, which puts the suffixes of
    phrases of SHARE bytes at a time, and of one trigger at least, into corpus order."""

    def phrases(batches):
        for batch, facts, begin, end in open_.merged(batches, ["g", "lo", "hi"]):
            held = np.flatnonzero(begin < end)
            if not len(held):
                continue
            g, lo, hi = (facts.column(k).to_numpy() for k in ("g", "lo", "hi"))
            texts = utf8(batch.column(1).take(pa.array(held)))
            for i, text in zip(held.tolist(), texts, strict=True):
                own = slice(begin[i], end[i])
                strings = [text[a : b + least] for a, b in zip(lo[own].tolist(), hi[own].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(g[own]), pa.array([batch.column(0)[i].as_py()] * len(strings), pa.int64()), pa.array(lo[own]), pa.array(strings, pa.binary())], names=["g", "row", "lo", "phrase"])

    def order(batches):
        group, size, last = [], 0, None

        def covered():
            starts = np.array([len(p) - least + 1 for _, _, p in group], np.int64)
            hit = suffixes.repeated([p for _, _, p in group], starts, least)
            first = np.cumsum(starts) - starts
            at = np.flatnonzero(hit)
            of = np.searchsorted(first, at, "right") - 1
            place = np.array([lo for _, lo, _ in group], np.int64)[of] + at - first[of]
            new = np.append(True, (np.diff(at) != 1) | (np.diff(of) != 0))[: len(at)]
            begins = np.flatnonzero(new)
            ends = np.append(begins[1:], len(at))[: len(begins)] - 1
            row = np.array([r for r, _, _ in group], np.int64)[of[begins]]
            return pa.RecordBatch.from_arrays([pa.array(row), pa.array(place[begins].astype(np.int32)), pa.array((place[ends] + least).astype(np.int32))], names=["row", "lo", "hi"])

        for batch in batches:
            for g, *phrase in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= SHARE and g != last:
                    yield covered()
                    group, size = [], 0
                group.append(phrase)
                size, last = size + len(phrase[2]), g
        if group:
            yield covered()

    dealt = rows.select("row", "text").mapInArrow(gives_back(phrases), "g long, row long, lo int, phrase binary").repartition("g").sortWithinPartitions("g")
    return dealt.mapInArrow(gives_back(order), "row long, lo int, hi int")


def repeated_spans(rows: DataFrame, least: int = 400) -> DataFrame:
    """``row, spans`` of those of the ``row, text`` rows that ``numbered`` wrote which have bytes in a string of ``least``
    bytes that also starts anywhere else: sorted spans of bytes that don't touch."""
    spark = rows.sparkSession
    limit_batches(spark)
    w = max(1, least // 2)
    copies = _copies(rows, least)
    others = Beside(copies.where("row != one").select("row"), "repeats-others")
    found = written(_triggers(rows, others, least, w), "repeats-triggers")
    others.release()
    shared = written(found.groupBy("g").agg(F.sum("n").alias("n")).where("n > 1").select("g"), "repeats-shared")
    hits = Beside(found.join(shared, "g").select("row", "g"), "repeats-hits")
    release(found, shared)
    parts = written(_stretches(rows, hits, least, w), "repeats-stretches")
    hits.release()
    every, steps = [], sorted({max(1, min(step, least // 4)) for step in STEPS}, reverse=True)
    for step, finer in zip([None, *steps], [*steps, None], strict=True):
        covered, open_ = _compared(parts, least, step == 1)
        every.append(covered)
        release(parts)
        if open_ is None:
            break
        few = Beside(open_.where(F.col("classes") <= PHRASES).select("row", "g", "lo", "hi"), "repeats-phrases")
        every.append(written(_ordered(rows, few, least), "repeats-covered"))
        few.release()
        many = Beside(open_.where(F.col("classes") > PHRASES).select("row", "g", "t", "lo", "hi"), "repeats-blocks")
        release(open_)
        if not many.files:
            break
        parts = written(_split(rows, many, least, finer), "repeats-parts")
        many.release()
    # a copied text goes as a whole, whatever else is known of it
    one = copies.select("row", F.lit(0).alias("lo"), F.col("n_bytes").alias("hi"))
    union = one
    for covered in every:
        union = union.unionByName(covered)
    spans = written(_merged(union), "repeats-spans")
    release(copies, *every)
    return spans


def _merged(covered: DataFrame) -> DataFrame:
    """``row, spans``: sorted spans that don't touch, of ``row, lo, hi`` rows that may overlap and repeat. A text's
    rows are as many as its bytes at most."""

    def run(batches):
        arrow = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        for batch in batches:
            out = []
            for rows in batch.column(1):
                flat = rows.values
                lo, hi = (flat.field(k).to_numpy() for k in (0, 1))
                order = np.argsort(lo, kind="stable")
                lo, reach = lo[order], np.maximum.accumulate(hi[order])
                first = np.flatnonzero(np.append(True, lo[1:] > reach[:-1]))
                out.append([{"lo": a, "hi": b} for a, b in zip(lo[first].tolist(), reach[np.append(first[1:], len(lo)) - 1].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, arrow)], names=["row", "spans"])

    return covered.groupBy("row").agg(F.collect_set(F.struct("lo", "hi")).alias("x")).select("row", "x").mapInArrow(gives_back(run), f"row long, spans {SPANS}")


def without_spans(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for a, b in spans:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]])


def whole_characters(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans of UTF-8 bytes without the characters that they cover in part."""
    out = []
    for a, b in spans:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        out.append((a, b))
    return out


def _with_spans(spans: Beside, batches, text: int):
    """Batches, their texts as bytes, and the spans of each."""
    for batch, facts, lo, hi in spans.merged(batches, ["spans"]):
        column = facts.column("spans") if facts is not None else None
        yield batch, utf8(batch.column(text)), [[(x["lo"], x["hi"]) for x in column[a].as_py()] if a < b else [] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 400) -> DataFrame:
    """``id_col, n_bytes, n_removed, n_spans, kept_sha256, kept_text`` for each row: what is left of each text's UTF-8 bytes without
    all that a string of ``least`` bytes covers which also starts elsewhere in the table, in the same text or another.
    ``kept_text`` is what is left as text; a character that was removed in part is there as a whole.

    All occurrences go, none is kept. Null texts are empty ones; texts shorter than ``least`` stay whole; repeated
    rows are copies of each other, whatever their ids."""
    rows = numbered(df.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text")), "repeats-texts")
    found = repeated_spans(rows.select("row", "text"), least)
    spans = Beside(found, "repeats-spans")
    release(found)

    def run(batches):
        for batch, texts, cuts in _with_spans(spans, batches, 2):
            kept = [without_spans(t, c) for t, c in zip(texts, cuts, strict=True)]
            whole = [k if not c else without_spans(t, whole_characters(t, c)) for t, c, k in zip(texts, cuts, kept, strict=True)]
            yield pa.RecordBatch.from_arrays([
                batch.column(1), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(t) - len(k) for t, k in zip(texts, kept, strict=True)], pa.int64()),
                pa.array([len(c) for c in cuts], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array(whole, pa.binary()).cast(pa.string()),
            ], names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    schema = rows.select("key").schema
    for name in ("n_bytes", "n_removed", "n_spans"):
        schema = schema.add(name, "long")
    out = rows.select("row", "key", "text").mapInArrow(gives_back(run), schema.add("kept_sha256", "string").add("kept_text", "string"))
    return out.withColumnRenamed("key", id_col)


def cut_texts(df: DataFrame, text_col: str = "text", least: int = 400) -> DataFrame:
    """The rows of ``df`` with repeated strings removed from their texts, to whole characters: one that a span covers
    in part stays. Null stays null."""
    names, kind = df.columns, df.schema[text_col].dataType
    rows = numbered(df.select(F.struct(*[F.col(f"`{c}`") for c in names if c != text_col], F.lit(0).alias(text_col)).alias("rest"), F.col(f"`{text_col}`").cast("string").alias("text")), "repeats-texts")
    found = repeated_spans(rows.select("row", "text"), least)
    spans = Beside(found, "repeats-spans")
    release(found)

    def run(batches):
        for batch, texts, cuts in _with_spans(spans, batches, 2):
            out = [without_spans(t, whole_characters(t, c)) if there else None for t, c, there in zip(texts, cuts, batch.column(2).is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.binary()).cast(pa.string())], names=["rest", "text"])

    out = rows.select("row", "rest", "text").mapInArrow(gives_back(run), rows.select("rest", "text").schema)
    return out.select(*[F.col("text").cast(kind).alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in names])
