"""Word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd

#: Bytes that one round of array operations takes; a longer text is cut between words.
PIECE = 1 << 20
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, ...]:
    """Powers of an odd number modulo 2^64, their inverses, and a random value of each byte."""
    base, out = 0xD1342543DE82EF95, []
    for b in (base, pow(base, -1, 1 << 64)):
        x = np.full(2 * PIECE + 64, b, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return *out, np.random.default_rng(8).integers(0, 1 << 64, 256, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of bytes that begin with a blank."""
    powers, inverses, values = _tables()
    blank = BLANK[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, ends = edge[::2], np.append(edge, len(data))[1::2]
    ends = ends[: len(starts)]
    total = np.zeros(len(data) + 1, np.uint64)
    if len(data) > len(powers):  # one endless word
        out = np.zeros(len(starts), np.uint64)
        for i, (a, b) in enumerate(zip(starts, ends, strict=True)):
            ahead = np.uint64(1)  # the power of the part's place in the word
            for c in range(a, b, PIECE):
                part = values[data[c : min(b, c + PIECE)]]
                with np.errstate(over="ignore"):
                    out[i] += ahead * (part * powers[: len(part)]).sum(dtype=np.uint64)
                    ahead *= powers[len(part)]
        return mixed(out), starts
    np.cumsum(values[data] * powers[: len(data)], out=total[1:])
    # sums that grow with the place are taken back to the word's start, so that both ways agree
    return mixed((total[ends] - total[starts]) * inverses[starts]), starts


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and how many each text has."""
    out, counts, block, size = [], np.zeros(len(texts), np.int64), [], 0

    def flush():
        if not block:
            return
        data = np.frombuffer(b" " + b" ".join(t for _, t in block), np.uint8)
        hashes, starts = _hashes(data)
        first = np.cumsum([0, *(len(t) + 1 for _, t in block)])
        np.add.at(counts, [i for i, _ in block], np.diff(np.searchsorted(starts, first)))
        out.append(hashes)
        block.clear()

    for i, text in enumerate(texts):
        at = 0
        while len(text) - at > PIECE:
            flush()
            size = 0
            cut = max(text.rfind(b, at + 1, at + PIECE) for b in (b" ", b"\n", b"\t", b"\x0b", b"\x0c", b"\r"))
            if cut < 0:
                break
            block.append((i, text[at:cut]))
            flush()
            at = cut
        part = text[at:] if at else text
        if size + len(part) > PIECE:
            flush()
            size = 0
        block.append((i, part))
        size += len(part) + 1
    flush()
    return np.concatenate(out) if out else np.zeros(0, np.uint64), counts


def shingles(texts: list[bytes], n: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, hash, count)`` of the distinct runs of ``n`` words of each text, in the order of the texts.

    Words part at ASCII white space. A text of 1 to n - 1 words has one shingle, of them all; one without words
    has none."""
    hashes, counts = words(texts)
    total = len(hashes)
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    padded = np.concatenate([hashes, np.zeros(n, np.uint64)])
    text = np.repeat(np.arange(len(texts)), counts)
    end = np.cumsum(counts)[text]  # of the text that each word is in
    left = np.minimum(end - np.arange(total), n)
    h = np.zeros(total, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + np.where(k < left, padded[k : k + total], np.uint64(0))
    h = mixed(h + left.astype(np.uint64))
    ok = (left == n) | ((counts[text] < n) & (left == counts[text]))
    text, h = text[ok], h[ok]
    codes, _ = pd.factorize(mixed(h + text.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
    number = int(codes.max()) + 1 if len(codes) else 0
    where = np.empty(number, np.int64)
    where[codes[::-1]] = np.arange(len(codes))[::-1]
    return text[where], h[where], np.bincount(codes, minlength=number)
