"""Hashes of words behind an endless one."""

from colframe.llm import shingles


def test_both_ways_agree(monkeypatch):
    text = b"some words of a text " + b"x" * 500 + b" and the words behind it"
    want = shingles.words([text])[0].tolist()
    assert len(want) == 11
    monkeypatch.setattr(shingles, "PIECE", 40)
    shingles._tables.cache_clear()
    try:
        assert len(shingles._tables()[0]) < len(text)
        assert shingles.words([text])[0].tolist() == want
        assert shingles.words([b"words behind it"])[0].tolist() == want[-3:]
    finally:
        shingles._tables.cache_clear()
