"""Operators 5 and 10 against the tokenizers library, text by text."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from colframe.llm import encoding, queries, tokenstore
from colframe.llm.bpe import LibraryEncoder, TableEncoder, TrieEncoder, vocabulary

PATH = queries.tokenizer_file()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


PIECES = ["don't", "'s", "''s", " 's", "\n's", " x", "\x1c", "\x85 ", "  a", "\t\n b", "été", "१२३", "½", "é", "漢字", "😀👍🏽", "'re'll've'd'm't", "<|endoftext|>", "<|endoftext", "1a2", "___", "\r\n\r\n", "　 x", "aaaaaaaaaaaaaaaa", " ", "\x00", "ǅ", "’s"]


@pytest.mark.parametrize("encoder", [lambda: TrieEncoder(vocabulary(PATH)), lambda: LibraryEncoder(PATH)])
def test_random_texts(library, encoder):
    rng = random.Random(1)
    texts = ["".join(rng.choices(PIECES, k=rng.randint(0, 30))) for _ in range(1500)]
    texts += ["".join(chr(rng.choice([rng.randint(1, 0x2FF), rng.randint(1, 0xD7FF), rng.randint(0xE000, 0x1FFFF)])) for _ in range(50)) for _ in range(500)]
    texts += ["", "a" * 3000, " " * 500, "'", "-" * 500]
    got = [x.tolist() for x in TableEncoder(PATH, encoder())(texts)]
    assert got == [ids_of(library, t) for t in texts]


def test_long_texts(library, monkeypatch):
    from colframe.llm import bpe

    monkeypatch.setattr(bpe, "PIECE", 1000)
    texts = ["the cat sat on the mat, " * 400, "x" * 5000, " " * 4000, "ab <|endoftext|> cd " * 300]
    assert [x.tolist() for x in TableEncoder(PATH)(texts)] == [ids_of(library, t) for t in texts]


def test_forgetting_changes_nothing(library, monkeypatch):
    from colframe.llm import bpe

    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    monkeypatch.setattr(bpe, "MEMO", 3)
    encode = TableEncoder(PATH)
    for t in ("hello world", "another hello", "world"):
        assert next(iter(encode([t]))).tolist() == ids_of(library, t)


def test_digests(spark, odd, library):
    rows = encoding.bpe_digests(odd, PATH).collect()
    texts = odd.select("doc_id", "text").collect()
    want = []
    for key, text in texts:
        ids = ids_of(library, text)
        want.append((key, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)


def test_encode_decode(spark, odd, empty):
    back = encoding.bpe_decode(encoding.bpe_encode(odd, PATH), PATH)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=repr)
    assert encoding.bpe_encode(empty, PATH).count() == 0


def expected(rows, library):
    """Documents in order: null ids first, ties by length and contents."""
    def root(ids):
        ends = tokenstore.chunk_ends(np.array(ids, np.uint32))
        return tokenstore.merkle_root([tokenstore.chunk_digest(np.array(ids[a:b], np.uint32)) for a, b in zip([0, *ends[:-1]], ends, strict=True)])

    docs = sorted(((r.doc_id is not None, r.doc_id or 0, [*ids_of(library, r.text), 2]) for r in rows), key=lambda x: (*x[:2], len(x[2]), root(x[2])))
    at = 0
    for there, key, ids in docs:
        yield key if there else None, at, ids
        at += len(ids)


def test_store(spark, odd, library):
    store = tokenstore.write_tokens(odd, PATH)
    want = list(expected(odd.collect(), library))
    assert sorted(map(tuple, store.checksums().collect()), key=repr) == sorted(((k, s, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for k, s, i in want), key=repr)
    assert sorted(map(tuple, store.documents().collect()), key=repr) == sorted(want, key=repr)
    assert store.index.count() == store.index.select("digest").distinct().count()
    assert store.manifest.agg(F.sum("documents")).first()[0] == odd.count()


def test_store_finds_damage(spark, odd):
    store = tokenstore.write_tokens(odd, PATH)
    pack = store.index.first()["pack"].removeprefix("file://")
    with open(pack, "r+b") as f:
        f.seek(4)
        f.write(b"\xff\xff")
    with pytest.raises(Exception):  # noqa: B017
        store.checksums().collect()


def test_empty_store(empty):
    assert tokenstore.write_tokens(empty, PATH).checksums().count() == 0


def test_query_over_the_table(spark, data, library):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op5_token_store(spark, data).collect()}
    at = 0
    for key, text in sorted(map(tuple, docs)):
        ids = [*ids_of(library, text), 2]
        assert got.pop(key) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert not got


def test_chunks_follow_contents():
    rng = np.random.default_rng(1)
    body = rng.integers(0, 50000, 20000).astype(np.uint32)
    a = tokenstore.chunk_ends(body)
    b = [e - 37 for e in tokenstore.chunk_ends(np.concatenate([rng.integers(0, 50000, 37).astype(np.uint32), body]))]
    assert len(set(a) & set(b)) > 0.7 * len(a)
    assert tokenstore.chunk_ends(np.zeros(100000, np.uint32))[-1] == 100000


def test_crc_of_parts():
    for a, b in ((b"", b""), (b"x", b""), (b"", b"y" * 7), (b"hello", b"w" * 4097)):
        assert tokenstore.crc_combined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
