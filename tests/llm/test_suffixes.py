"""Corpus order by prefix-free parsing against sorting, and operator 4 where triggers have more phrases than a task takes."""

import random
from collections import Counter

import numpy as np
import pytest

from colframe.llm import repeats, suffixes

from .test_duplicates import brute_repeats, corpus


@pytest.mark.parametrize("alphabet", ["ab", "a", "abcdefgh", "\0\xff a"])
def test_corpus_order(alphabet):
    r = random.Random(1)
    for _ in range(40):
        base, least = "".join(r.choices(alphabet, k=300)), r.choice([8, 20, 21, 64])
        texts = [(base[(a := r.randint(0, 250)) : a + r.randint(20, 200)] + "".join(r.choices(alphabet, k=r.randint(0, 80)))).encode("latin1") for _ in range(r.randint(1, 12))]
        texts = [t for t in texts if len(t) >= least] or [b"x" * least]
        starts = np.array([r.randint(0, len(t) - least + 1) for t in texts])
        joined, first = b"".join(texts), np.cumsum([0, *map(len, texts)])
        string = {int(first[i]) + k: texts[i][k : k + least] for i in range(len(texts)) for k in range(starts[i])}
        if string:
            order = suffixes.corpus_order(texts, np.array(list(string)), least)
            assert [string[p] for p in order.tolist()] == sorted(string.values())
        times = Counter(string.values())
        assert suffixes.repeated(texts, starts, least).tolist() == [times[s] > 1 for s in string.values()] and len(joined) == first[-1]


@pytest.mark.parametrize(("seed", "phrases"), [(0, 1), (1, 3)])
def test_many_phrases(spark, monkeypatch, seed, phrases):
    """All triggers go through blocks of starts."""
    monkeypatch.setattr(repeats, "PHRASES", phrases)
    texts = corpus(seed)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(df, least=40).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats([(t or "").encode() for t in texts], 40)
