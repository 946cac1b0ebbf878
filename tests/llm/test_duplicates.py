"""Operators 4, 7 and 8 against brute force."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from colframe.llm import components, minhash, queries, repeats, shingles, vectors

# ---- repeated strings


def brute_repeats(texts, least):
    count = Counter(t[s : s + least] for t in texts for s in range(len(t) - least + 1))
    out = []
    for t in texts:
        mark = np.zeros(len(t) + 1, int)
        for s in range(len(t) - least + 1):
            if count[t[s : s + least]] > 1:
                mark[s] += 1
                mark[s + least] -= 1
        hit = np.cumsum(mark)[:-1] > 0
        kept = bytes(b for b, h in zip(t, hit) if not h)  # noqa: B905
        out.append((len(t), int(hit.sum()), int((np.diff(np.append(0, hit.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    alphabet = "abcdefgh é" if seed % 2 else "ab "
    passages = ["".join(r.choices(alphabet, k=r.randint(20, 300))) for _ in range(6)]
    texts = []
    for _ in range(40):
        parts = ["".join(r.choices(alphabet, k=r.randint(0, 150)))]
        for _ in range(r.randint(0, 4)):
            p = r.choice(passages)
            a = r.randint(0, len(p) // 2)
            parts += [p[a : r.randint(a, len(p))], "".join(r.choices(alphabet, k=r.randint(0, 60)))]
        texts.append("".join(parts))
    return [*texts, texts[0], texts[0], "x" * 500, "ab" * 200, "", None, passages[0]]


@pytest.mark.parametrize(("seed", "least"), [(0, 50), (1, 50), (2, 30), (3, 61)])
def test_repeats(spark, seed, least):
    texts = corpus(seed)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(df, least=least).collect()}
    want = brute_repeats([(t or "").encode() for t in texts], least)
    assert [got[i] for i in range(len(texts))] == want


def test_repeats_in_pieces(spark, monkeypatch):
    """Texts longer than a round of array operations, in this process and so in pieces of 1024 bytes."""
    r = random.Random(4)
    passage = bytes(r.choices(range(97, 123), k=700))
    texts = [bytes(r.choices(range(97, 123), k=3000)) + passage + b"q" * 300, passage[100:] + bytes(r.choices(range(97, 123), k=2500)), b"xy" * 1500]
    monkeypatch.setattr(repeats, "PIECE", 1024)
    monkeypatch.setattr(repeats, "PLACE_BITS", 10)
    least, w, found = 100, 50, {}
    for group in repeats.pieces(texts, least):
        piece, t, lo, hi, g, k1, k2 = repeats.stretches(group, least, w, True)
        offsets = np.array([o for _, o, _ in group]) - np.cumsum([0, *(len(p) for _, _, p in group)])[:-1]
        for p, a, b in zip(piece, lo, hi):  # noqa: B905
            for s in range(a + offsets[p], b + offsets[p] + 1):
                key = (group[p][0], s)
                assert key not in found
                found[key] = 1
    assert set(found) == {(i, s) for i, t in enumerate(texts) for s in range(len(t) - least + 1)}


def test_repeats_odd(odd, empty):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    want = Counter((k, *w) for (k, _), w in zip(rows, brute_repeats([(t or "")[:3000].encode() for _, t in rows], 400)))  # noqa: B905
    got = repeats.remove_repeats(odd).collect()
    assert len(got) == len(rows) and repeats.remove_repeats(empty).count() == 0
    # every text of 400 bytes or more is there twice, and goes
    assert all(r.n_removed == (r.n_bytes if r.n_bytes >= 400 else 0) for r in got) and want


def test_cut_texts(spark, odd):
    passage = "é" * 30 + "".join(random.Random(5).choices("abcdef ", k=300))
    df = spark.createDataFrame([(1, "ü" + passage + "é tail", 1), (2, "head è" + passage + "ö", 2), (3, None, 3)], "doc_id long, text string, spans int")
    out = {r.doc_id: r.text for r in repeats.cut_texts(df, least=100).collect()}
    assert out[3] is None and all(passage[1:-1] not in out[i] for i in (1, 2))
    assert out[1].startswith("ü") and out[1].endswith(" tail") and out[2].startswith("head ")
    assert repeats.cut_texts(df, least=100).columns == df.columns


# ---- near-duplicate documents


def words(text):
    return [w for w in text.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]


def bag(text, n=5):
    w = words(text)
    return Counter([tuple(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [tuple(w)] if w else [])


def brute_classes(texts, least=0.8):
    bags, root = [bag(t or "") for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            if both and both / sum((bags[i] | bags[j]).values()) >= least:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def near_copies(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(2000)]
    texts = []
    for _ in range(25):
        base = r.choices(vocabulary, k=r.choice([3, 6, 40, 200, 600]))
        texts.append(" ".join(base))
        for _ in range(r.choice([0, 0, 2, 6])):
            copy = list(base)
            for _ in range(r.choice([0, 1, 2, 5, 12])):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            texts.append(r.choice([" ", "\n", "\t "]).join(copy))
    chain = r.choices(vocabulary, k=300)
    for step in range(12):  # each like the next, the ends unlike
        texts.append(" ".join(chain))
        for k in range(5):
            chain[step * 20 + k * 3] = r.choice(vocabulary)
    return [*texts, "spam " * 500, "spam " * 520, "spam " * 100, "", "  ", None, "one two", "one  two"]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    texts = near_copies(seed)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.class_id, r.kept) for r in minhash.near_duplicates(df).collect()}
    want = brute_classes(texts)
    assert [got[i] for i in range(len(texts))] == [(c, c == i) for i, c in enumerate(want)]


@pytest.mark.parametrize("block", [1000, 3])
def test_near_duplicates_last_round(spark, monkeypatch, block):
    """No rounds against one member: all is left to the last one."""
    monkeypatch.setattr(minhash, "PIVOT_ROUNDS", 0)
    monkeypatch.setattr(minhash, "CROSS_BLOCK", block)
    texts = near_copies(3)[:60]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


def test_near_duplicates_odd(odd, empty):
    out = minhash.near_duplicates(odd).collect()
    assert len(out) == odd.count() and minhash.near_duplicates(empty).count() == 0
    blank = [r for r in out if r.doc_id in (0, 1, 2, 10, 11, 12)]
    assert all(r.class_id == r.doc_id and r.kept for r in blank)
    assert {r.class_id for r in out if r.doc_id in (6, 16)} == {6}


def test_weighted_signatures_are_unbiased():
    r, errors = random.Random(3), []
    for k in range(60):
        a = Counter({j: r.choice([1, 1, 2, 3, 7, 20]) for j in range(60)})
        b = Counter(a)
        for j in r.sample(range(60), k % 40):
            b[j] = r.choice([0, 1, 5, 9])
        jaccard = sum((a & b).values()) / sum((a | b).values())
        parts = [(np.full(len(x), i), shingles.mixed(np.array(list(x), np.uint64) + np.uint64(1000 * k + 1)), np.array(list(x.values()))) for i, x in enumerate((+a, +b))]
        s = minhash.signatures(*(np.concatenate(p) for p in zip(*parts)), 2, m=960)  # noqa: B905
        errors.append((s[0] == s[1]).mean() - jaccard)
    assert abs(np.mean(errors)) < 0.006 and np.std(errors) < 0.025


def test_shingles(monkeypatch):
    texts = ["a b c d e f g", "", " \n", "a b", "a b  c\td e", "x " * 50]
    def bags(texts):
        t, h, c = shingles.shingles([x.encode() for x in texts])
        return [dict(zip(h[t == i].tolist(), c[t == i].tolist())) for i in range(len(texts))]  # noqa: B905
    got = bags(texts)
    assert [sorted(g.values()) for g in got] == [sorted(bag(t).values()) for t in texts]
    assert set(got[4]) < set(got[0])
    monkeypatch.setattr(shingles, "PIECE", 40)
    assert bags(texts) == got


# ---- vectors


def brute_vectors(rows, least=0.95):
    good = {i for i, v in enumerate(rows) if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    unit = {i: (x := np.array(rows[i]) / np.abs(rows[i]).max()) / np.sqrt(x @ x) for i in good}
    links = {i: {j for j in good if j != i and len(rows[j]) == len(rows[i]) and unit[i] @ unit[j] >= least} if i in good else set() for i in range(len(rows))}
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            todo += (new := links[todo.pop()] - seen)
            seen |= new
        out.append((len(links[i]), min(seen), min(seen) == i))
    return out


def some_vectors():
    r = np.random.default_rng(2)
    rows = [r.standard_normal(24) for _ in range(150)]
    for k, spread in ((20, 0.05), (15, 0.2), (30, 0.25)):
        centre = r.standard_normal(24)
        rows += [centre + spread * r.standard_normal(24) for _ in range(k)]
    rows += [rows[0] * 3, rows[1], -rows[2], rows[3] * 1e-200, rows[4] * 1e200]
    return [x.tolist() for x in rows] + [None, [], [0.0] * 24, [float("nan")] * 24, [1.0, None], [float("inf")] + [0.0] * 23, [1.0] * 5, [2.0] * 5]


@pytest.mark.parametrize("block", [1000, 7])
def test_near_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "MISS", 1e-9)
    rows = some_vectors()
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df).collect()}
    assert [got[i] for i in range(len(rows))] == brute_vectors(rows)


def test_near_vectors_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.near_vectors(df).count() == 0


def test_recall(spark, data):
    """Against brute force over a table of near copies made from the test vectors: at least 0.9, and nothing below."""
    base = np.array([r.embedding for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()])[:120]
    r = np.random.default_rng(1)
    rows = np.concatenate([base, *(base + r.normal(0, 0.04, base.shape) for _ in range(3))])
    df = spark.createDataFrame(list(enumerate(rows.tolist())), "vec_id long, embedding array<double>")
    got = {x.vec_id: x.n_links for x in vectors.near_vectors(df).collect()}
    want = brute_vectors(rows.tolist())
    assert all(got[i] <= w[0] for i, w in enumerate(want))
    assert sum(got.values()) >= 0.99 * sum(w[0] for w in want)


# ---- components


@pytest.mark.parametrize("task_links", [1_000_000, 20])
def test_components(spark, monkeypatch, task_links):
    monkeypatch.setattr(components, "TASK_LINKS", task_links)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 540)] + [(7, 7), (3, 2), (2, 3), (9, 3), (None, 4)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 500 for i in range(500, 540)} | {2: 2, 3: 2, 9: 2}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_queries(spark, data):
    docs = sorted(map(tuple, spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op4_repeats(spark, data).collect()}
    assert [got[k] for k, _ in docs] == brute_repeats([t.encode() for _, t in docs], 400)
