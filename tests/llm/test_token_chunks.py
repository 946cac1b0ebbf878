"""Chunk ends of many texts at once, and ids of many words in one call."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from colframe.llm import tokenstore
from colframe.llm.bpe import LibraryEncoder, TrieEncoder, vocabulary

PATH = public_tokenizers.path("byte_bpe_50k.json")


def ends_one_by_one(ids):
    """Each id counts in the hash of the LOOK ids up to a place by its distance from it."""
    values, factor = tokenstore._values(), 0x9E3779B97F4A7C15
    out, at = [], 0
    for i in range(len(ids)):
        n = i + 1 - at
        h = sum(int(values[int(ids[i - d])]) * pow(factor, d, 1 << 64) for d in range(tokenstore.LOOK) if i >= d) % (1 << 64) if n >= tokenstore.LEAST else 0
        if n == tokenstore.MOST or (n >= tokenstore.LEAST and h >> 40 & tokenstore.MASK == 0 and len(ids) - at > tokenstore.LEAST):
            out.append(i + 1)
            at = i + 1
    return out + [len(ids)] * (at < len(ids))


@pytest.mark.parametrize("hashed", [1, 500, tokenstore.HASHED])
def test_texts_hashed_together_have_their_own_ends(monkeypatch, hashed):
    monkeypatch.setattr(tokenstore, "HASHED", hashed)
    rng = np.random.default_rng(1)
    sizes = [1, 127, 128, 129, 1, 700, 3000, 2, 130, 5000, 1, 15, 16]
    texts = [rng.integers(0, 50_000, n).astype(np.uint32) for n in sizes] + [np.zeros(9000, np.uint32)]
    got = list(tokenstore.chunked(iter(texts)))
    assert [ids.tolist() for ids, _ in got] == [t.tolist() for t in texts]
    assert [ends for _, ends in got] == [ends_one_by_one(t) for t in texts] == [tokenstore.chunk_ends(t) for t in texts]
    assert list(tokenstore.chunked([])) == []


@pytest.mark.parametrize("encoder", [lambda: TrieEncoder(vocabulary(PATH)), lambda: LibraryEncoder(PATH)])
def test_flat_ids_of_words(encoder):
    words = ["the", " the", "", "Ünïcødé", " 日本語", "\x00\x7f", "ÿ", "Ā", "🙂", " ", "\n\n", "x" * 300]
    ids, lengths = encoder().flat([w.encode() for w in words])
    library = Tokenizer.from_file(PATH).model
    alphabet = tokens_alphabet()
    expected = [[t.id for t in library.tokenize("".join(alphabet[b] for b in w.encode()))] if w else [] for w in words]
    assert lengths == list(map(len, expected))
    assert ids == [i for x in expected for i in x]
    assert encoder().flat([]) == ([], [])


def tokens_alphabet():
    """GPT-2's stand-ins of bytes: printable Latin-1 for itself, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}
