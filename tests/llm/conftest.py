import pytest

#: Texts that every operator has to stand: null, empty, blank, repeated, of one endless word, and long.
ODD = [None, "", " \n\t ", "a", "Ünïcode é 漢字 👍", "<|endoftext|> x", "the cat sat on the mat " * 3000, "x" * 5000, "don't we'll 12 345\n\n  y", "\x00\x01 b"]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts twice over, a null id, a null source, and columns whose names operators use inside."""
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else f"s{i % 3}", i, "h") for i, t in enumerate([*ODD, *ODD])] + [(None, "null id", "de", "s1", 0, "h"), (5, ODD[5], "en", "s2", 5, "h")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size int, hash string")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
