"""Operator 1 against a plain computation."""

import hashlib
import re

import pytest

from colframe.llm import mixing


def brute(rows, weights=(3, 1, 2), budget=1.5, cap=2.0):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    names = sorted({s for *_, s in rows if s is not None}) + ([None] if any(s is None for *_, s in rows) else [])
    total = {n: sum(k for k, (*_, s) in zip(size, rows) if s == n) for n in names}  # noqa: B905
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    target, open_, left = {}, set(names), budget * sum(total.values())
    while open_:
        level = left / sum(weight[n] for n in open_)
        full = {n for n in open_ if cap * total[n] <= level * weight[n]}
        for n in full or open_:
            target[n] = cap * total[n] if full else level * weight[n]
        left -= sum(target[n] for n in full)
        open_ = open_ - full if full else set()
    return size, total, target


@pytest.fixture(scope="module")
def rows(spark, data):
    return [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "source").collect()]


def check(out, rows):
    size, total, target = brute(rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r["size"]) for r in out) == sorted((k is not None, k or 0, n) for (k, *_), n in zip(rows, size))  # noqa: B905
    taken = {}
    for r in out:
        assert r.source_size == total[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken == r.copies * r["size"] and r.copies in (0, 1, 2)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, n in taken.items():
        group = {}
        for (k, _, source), z in zip(rows, size):  # noqa: B905
            if source == s:
                group[k] = group.get(k, 0) + z
        assert abs(n - target[s]) <= max(group.values(), default=0) / 2 + 1e-6


def test_table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check(mixing.mix(df).collect(), rows)


def test_reruns_and_partitions_agree(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a, b = (sorted(map(tuple, mixing.mix(x).select("doc_id", "taken").collect())) for x in (df.repartition(1), df.repartition(7)))
    assert a == b


def test_odd(spark, odd):
    check(mixing.mix(odd).collect(), [tuple(r) for r in odd.select("doc_id", "text", "source").collect()])


def test_deep_refinement(spark, rows, monkeypatch):
    """One hex digit at a time: many levels, the same result."""
    df = spark.createDataFrame(rows[:60], "doc_id long, text string, source string")
    want = sorted(map(tuple, mixing.mix(df).select("doc_id", "taken").collect()))
    monkeypatch.setattr(mixing, "DIGITS", 1)
    assert sorted(map(tuple, mixing.mix(df).select("doc_id", "taken").collect())) == want


def test_without_broadcast(spark, odd, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    check(mixing.mix(odd).collect(), [tuple(r) for r in odd.select("doc_id", "text", "source").collect()])


def test_empty(empty):
    assert mixing.mix(empty).count() == 0 and mixing.apply_mix(empty).count() == 0


def test_applied(spark, odd):
    taken = {(r.doc_id, r.source, r["size"]): r.copies for r in mixing.mix(odd).collect()}
    out = mixing.apply_mix(odd)
    assert out.columns == odd.columns and out.count() == sum(r.copies for r in mixing.mix(odd).collect()) and taken


def test_hash_is_known(spark):
    df = spark.createDataFrame([(7,)], "doc_id long")
    assert df.select(mixing.row_hash(df.doc_id)).first()[0] == hashlib.md5(b"7").hexdigest()
