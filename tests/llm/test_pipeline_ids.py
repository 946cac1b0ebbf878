"""One row of each class stays, whatever the ids are."""

import random

import corpus_pipeline


def kept(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == corpus_pipeline.COLUMNS
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)


def texts(n):
    r = random.Random(4)
    return [" ".join(r.choices([f"w{i}" for i in range(500)], k=100)) for _ in range(n)]


def test_null_ids(spark):
    a, b, c = texts(3)
    assert kept(spark, [(3, a), (None, a), (None, b), (None, c), (None, c + " more")]) in [sorted([(3, a), (None, b), (None, x)], key=repr) for x in (c, c + " more")]


def test_reused_ids(spark):
    a, b = texts(2)
    assert kept(spark, [(3, a), (5, a + " more"), (5, b), (7, b + " more")]) == sorted([(3, a), (5, b)], key=repr)


def test_near_texts_of_one_id(spark):
    a, b = texts(2)
    out = kept(spark, [(1, a), (1, a + " more"), (1, a + " most"), (2, b), (2, b)])
    assert len(out) == 2 and out[1] == (2, b)


def test_without_words(spark):
    assert kept(spark, [(1, ""), (1, ""), (2, " \n"), (None, None), (None, None), (3, None)]) == sorted([(1, ""), (2, " \n"), (None, None), (3, None)], key=repr)
