"""Operators 3 and 9, and the pipeline."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from colframe.llm import html, langid, queries

# ---- language identification


def test_held_out_accuracy(spark, data):
    rows = queries.op3_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.98
    assert np.mean([r.accepted for r in held]) > 0.98


def test_language_odd(odd, empty):
    rows = langid.identify(odd).collect()
    assert len(rows) == odd.count() and langid.identify(empty).count() == 0
    for r in rows:
        if r.doc_id in (0, 1, 2, 10, 11, 12):
            assert (r.lang_pred, r.score, r.accepted) == ("und", 0.0, False)
        elif r.doc_id is not None and r.doc_id not in (9, 19):
            assert r.lang_pred in ("en", "de")
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}


def test_labels_and_ids_are_no_inputs(spark, odd):
    model = langid.fit(odd, fold=None)
    a = langid.predict(odd.select("text"), model).orderBy("text").collect()
    b = langid.predict(odd.withColumn("lang", F.lit("xx")).select("lang", "text"), model).orderBy("text").select("text", "lang_pred", "score", "accepted").collect()
    assert a == b


@pytest.mark.parametrize("unknown", ["de", "en", "es", "fr"])
def test_rejects_a_language_that_was_not_learned(spark, unknown):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("lang is not null and text is not null")
    model = langid.fit(docs.where(F.col("lang") != unknown))
    assert unknown not in model.languages
    rows = langid.predict(docs.where(langid.in_fold(F.col("doc_id"), 2, 4)), model, keep=["lang"]).collect()
    known, other = ([r.accepted for r in rows if (r.lang == unknown) == x] for x in (False, True))
    assert np.mean(known) > 0.98 and np.mean(other) < 0.1


def test_scores_of_a_perfect_model_stay_apart():
    texts, langs = ["the cat sat on a mat", "der hund und die katze"] * 60, ["en", "de"] * 60
    model = langid.train(texts, langs)
    assert model.temperature > 0.05 and (model.scores(texts).argmax(1) == [1, 0] * 60).all()
    assert (model.scores(texts).max(1) >= model.thresholds(texts)).all()
    alone = langid.train(["the cat sat on a mat"] * 9, ["en"] * 9)
    assert (alone.scores(["der hund"]) == 1).all() and (alone.thresholds(["der hund"]) <= 1).all()
    for few in (1, 2, 4):
        model = langid.train(texts[:few], langs[:few])
        assert (model.scores(texts).max(1) <= 1).all() and len(model.thresholds(texts)) == len(texts)


def test_long_text_is_summed_whole(monkeypatch):
    model = langid.train(["the cat sat on a mat"] * 30 + ["der hund und die katze"] * 30, ["en"] * 30 + ["de"] * 30)
    text = "the cat " * 300 + "und die " * 900
    whole = langid.text_means([text], model.table)
    monkeypatch.setattr(langid, "PIECE", 500)
    assert np.allclose(whole, langid.text_means([text], model.table), atol=1e-9)


# ---- main text


def test_generated_pages():
    model, writer = html.trained(), html.Writer(77)
    hit = extra = missed = 0
    for _ in range(120):
        root = html.parse(writer.page())
        html._marked(root)
        nodes, x = html.features(root, model.vocabulary)
        kept = html.decode(nodes, model.trees.logits(x))
        for n in nodes:
            if n.text is not None:
                hit += n.truth and id(n) in kept
                extra += not n.truth and id(n) in kept
                missed += n.truth and id(n) not in kept
    assert hit / (hit + extra) > 0.95 and hit / (hit + missed) > 0.95


def test_decoding_has_no_contradictions():
    rng = np.random.default_rng(3)
    for seed in range(20):
        root = html.parse(html.Writer(seed).page())
        nodes, _ = html.features(root, {})
        kept = html.decode(nodes, rng.normal(0, 3, len(nodes)))
        assert all(n.parent is None or id(n.parent) in kept for n in nodes if id(n) in kept)


def test_decoding_is_the_best_choice():
    root = html.parse("<div><p>a<p>b</div><div><p>c</div>")
    nodes, _ = html.features(root, {})
    rng = np.random.default_rng(5)
    for _ in range(50):
        z = rng.normal(0, 2, len(nodes))
        kept = html.decode(nodes, z)
        index = {id(n): i for i, n in enumerate(nodes)}

        def allowed(bits):
            return bits & 1 and all(not bits >> i & 1 or n.parent is None or bits >> index[id(n.parent)] & 1 for i, n in enumerate(nodes))

        best = max(sum(z[i] for i in range(len(nodes)) if b >> i & 1) for b in range(1 << len(nodes)) if allowed(b))
        assert sum(z[index[k]] for k in kept) == pytest.approx(best)


def blocks(page):
    out = []

    def walk(n):
        if n.text is not None and (t := html.block_text(n)):
            out.append(t)
        for c in n.children:
            walk(c)

    walk(html.parse(page))
    return out


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", []), ("plain &amp; simple", ["plain & simple"]), ("<p>a<p>b<br>c</p>d", ["a", "b c", "d"]), ("<p><b>x <br><p>y", ["x", "y"]),
        ("<ul><li>1<li>2</ul>", ["1", "2"]), ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]), ("a<script>var x='</p><b>';</script>b<style>p{}</style>", ["ab"]),
        ("1 < 2 &lt;b&gt; &am &amp", ["1 < 2 <b> &am &"]), ("x<!-- <p>no</p> -->y", ["xy"]), ("<p>a</div></span>b</p>", ["ab"]), ("<p>cut <a href='x", ["cut"]), ("<p>  a \n\t b </p>", ["a b"]),
        ("<title>t</title><h1>h</h1>", ["h"]), ("<p title='a>b'>q</p>", ["q"]),
    ],
)
def test_parser(page, want):
    assert blocks(page) == want


def test_extract_odd(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article><p>Hello &amp; goodbye to all of you.</p></article>"), (4, "v", "<div " * 2000), (5, "w", "<p>" * 3000 + "x"), (6, "x", "<b>" * 5000 + "y")]
    out = {r.page_id: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(out) == 6 and out[1].text == out[2].text == "" and out[None].text == "Hello & goodbye to all of you."
    assert all(r.n_chars == len(r.text) for r in out.values())


def test_pages_table(spark, data):
    """The test pages have one article each, of headings and paragraphs."""
    import html as entities

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    for r in queries.op9_main_text(spark, data).collect():
        body = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        parts = re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", re.sub(r"</?(h1|p)>", "\x01", body))).split("\x01")
        assert r.text == "\n".join(t for p in parts if (t := " ".join(entities.unescape(p).split())))


# ---- pipeline


def test_pipeline(spark, data):
    from tests.llm.test_duplicates import brute_classes, brute_repeats

    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert 4 <= len(stages) <= 5
    known = stages["language_id"](spark, docs, data).cache()
    assert known.columns == corpus_pipeline.COLUMNS
    kept = sorted(r.doc_id for r in known.collect())
    assert len(kept) > 0.98 * len(texts)
    single = stages["near_duplicates"](spark, known, data).cache()
    classes = brute_classes([texts[k] for k in kept])
    assert sorted(r.doc_id for r in single.collect()) == [k for i, k in enumerate(kept) if classes[i] == i]
    cut = stages["repeated_strings"](spark, single, data).cache()
    left = {r.doc_id: r.text for r in cut.collect()}
    rows = sorted((r.doc_id, r.text) for r in single.collect())
    for (k, t), (n, removed, *_) in zip(rows, brute_repeats([t.encode() for _, t in rows], corpus_pipeline.REPEATED_BYTES), strict=True):
        size = len(left.get(k, "").encode())
        assert n - removed <= size <= n - removed + 8 * (removed > 0) and (k in left) == bool(size) and (removed or left[k] == t)
    mixed = stages["source_mix"](spark, cut, data).cache()
    assert mixed.columns == corpus_pipeline.COLUMNS and {r.doc_id for r in mixed.collect()} <= set(left)
    out = stages["bpe"](spark, mixed, data)
    assert out.count() == mixed.count()
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, data).collect()) == sorted(r.doc_id for r in mixed.collect())


def test_pipeline_drops_what_it_should(spark):
    text = " ".join(f"the {w} thing is of an old house" for w in ("red", "green", "blue", "grey"))
    rows = [(i, t, "en", "a", 1) for i, t in enumerate([text, text, text + " now", None, "123 456", "und der hund ist in dem alten haus bei den vielen kleinen katzen"])] + [(0, text, "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    single = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in single.collect()) == [0, 3, 4, 5]
