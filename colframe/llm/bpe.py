"""Byte-level BPE over whole tables: exact word splitting in numpy, and encoding of distinct words by a trie.

A tokenizer file of the byte-level BPE family (as the ``tokenizers`` library writes it) splits a text into words
and merges bytes inside each word. Both parts are done here on many texts at a time:

* ``WordSplitter`` finds the word borders of the family's pattern with array operations on code points;
* ``TrieEncoder`` puts the distinct words in order, so that walking them is a depth-first walk of their trie. The
  state of a node is the last token of the encoding of its prefix. It follows from the states of the node's
  ancestors: it is the one token that ends there and may stand after the last token of what precedes it. So a
  prefix that many words share is encoded once.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pandas as pd
import regex

#: Code points that are cut out for one round of array operations.
PIECE = 1 << 20
#: Distinct words that a worker remembers.
REMEMBERED = 500_000
#: Pairs of tokens, and states, that a worker remembers.
MEMO = 1_000_000
#: The contractions that the byte-level pattern splits off after an apostrophe.
SHORT_1, SHORT_2 = "stmd", ("re", "ve", "ll")


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes: the printable Latin-1 ones stand for themselves, the others are
    numbered from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """What a tokenizer file says: bytes of each id, merge ranks, and texts that are ids as they stand."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
            raise NotImplementedError("only byte-level BPE files without normalizer or prefix space are supported")
        if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            raise NotImplementedError("this option of the BPE model isn't supported")
        to_byte = byte_alphabet()
        self.id_of = {bytes(to_byte[c] for c in token): i for token, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec.get("added_tokens") or []):
            raise NotImplementedError("added tokens that strip or match words aren't supported")
        self.size = 1 + max([*self.id_of.values(), *self.special.values()])
        self.bytes_of: list[bytes] = [b""] * self.size
        for token, i in self.id_of.items():
            self.bytes_of[i] = token
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode()
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # of a merged token: left, right, rank
        for n, pair in enumerate(model["merges"]):
            a, b = (self.id_of[bytes(to_byte[c] for c in x)] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            made = self.id_of[self.bytes_of[a] + self.bytes_of[b]]
            self.rank[a, b] = n
            self.parts.setdefault(made, (a, b, n))
        self.length_of = [len(x) for x in self.bytes_of]
        self.begins = {token[:n] for token in self.id_of for n in range(len(token) + 1)}


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """One for a worker process, whatever the number of its tasks."""
    return Vocabulary(path)


class TrieEncoder:
    """Encodes many distinct words by walking their trie depth first."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self._reset()

    def _reset(self) -> None:
        self.right: dict[int, list[tuple[int, int]]] = {}
        self.left: dict[int, list[tuple[int, int]]] = {}
        self.follows: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.states: dict[bytes, int] = {}
        self.texts: list[bytes] = []
        self.ends: list[list[tuple[int, int]]] = []
        self.steps: dict[int, int] = {}
        self._state(b"")

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The parts of ``token`` that touch its right (1) or left (0) end, smallest first, with merge ranks."""
        memo = self.right if side else self.left
        if token not in memo:
            out, t = [], token
            while t in self.vocab.parts:
                out.append((t, self.vocab.parts[t][2]))
                t = self.vocab.parts[t][side]
            memo[token] = [(t, -1), *reversed(out)]
        return memo[token]

    def may_follow(self, a: int, b: int) -> bool:
        """True if no merge across the border comes before those that make ``a`` and ``b``.

        Both sides grow by rank; of two merges of equal rank the left one is made first."""
        key = a << 32 | b
        known = self.follows.get(key)
        if known is None:
            known = self.follows[key] = self._may_follow(a, b)
        return known

    def _may_follow(self, a: int, b: int) -> bool:
        left, right, rank = self._spine(a, 1), self._spine(b, 0), self.vocab.rank
        i = j = 0
        never = 1 << 60
        while True:
            next_left = left[i + 1][1] if i + 1 < len(left) else never
            next_right = right[j + 1][1] if j + 1 < len(right) else never
            across = rank.get((left[i][0], right[j][0]))
            if across is not None and across < next_left and across <= next_right:
                return False
            if next_left == next_right == never:
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1

    def stands(self, token: int) -> bool:
        """True if the token's own bytes encode to it alone."""
        known = self.whole.get(token)
        if known is None:
            parts = self.vocab.parts.get(token)
            known = self.whole[token] = (parts is None and len(self.vocab.bytes_of[token]) == 1) or (parts is not None and self.stands(parts[0]) and self.stands(parts[1]) and self._joined(*parts))
        return known

    def _joined(self, a: int, b: int, n: int) -> bool:
        """True if nothing across the border of ``a`` and ``b`` is merged before their own merge, of rank ``n``."""
        left, right, rank = self._spine(a, 1), self._spine(b, 0), self.vocab.rank
        i = j = 0
        never = 1 << 60
        while True:
            next_left = left[i + 1][1] if i + 1 < len(left) else never
            next_right = right[j + 1][1] if j + 1 < len(right) else never
            if next_left == next_right == never:
                return rank.get((a, b)) == n
            across = rank.get((left[i][0], right[j][0]))
            if across is not None and across < next_left and across <= next_right:
                return False
            if next_left <= next_right:
                i += 1
            else:
                j += 1

    def _state(self, text: bytes) -> int:
        """The number of the state whose longest part that begins a token is ``text``; its tokens, longest first,
        are those that end where it ends."""
        found = self.states.get(text)
        if found is None:
            found = self.states[text] = len(self.texts)
            self.texts.append(text)
            ends = [(t, len(text) - a) for a in range(len(text)) if (t := self.vocab.id_of.get(text[a:])) is not None and self.stands(t)]
            self.ends.append(ends)
        return found

    def _step(self, state: int, byte: int) -> int:
        text = self.texts[state] + bytes((byte,))
        while text not in self.vocab.begins:
            text = text[1:]
        found = self.steps[state << 8 | byte] = self._state(text)
        return found

    def __call__(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word, in the order given."""
        order = sorted(range(len(words)), key=words.__getitem__)
        out: list[list[int]] = [[]] * len(words)
        step, follows, may_follow, ends = self.steps.get, self.follows, self.may_follow, self.ends
        known, length_of = follows.get, self.vocab.length_of
        # of the first d bytes on the path from the root: the last token, and the state of the automaton of tokens
        last, states, before, depth = [0], [0], b"", 0
        for k in order:
            word = words[k]
            n, most = len(word), min(len(word), len(before))
            if word[:most] == before[:most]:
                depth = most
            else:
                depth = 0
                while word[depth] == before[depth]:
                    depth += 1
            del last[depth + 1 :], states[depth + 1 :]
            state = states[depth]
            for d in range(depth + 1, n + 1):
                now = step(state << 8 | word[d - 1])
                state = self._step(state, word[d - 1]) if now is None else now
                states.append(state)
                for token, size in ends[state]:
                    if size == d:
                        break
                    previous = last[d - size]
                    ok = known(previous << 32 | token)
                    if ok or (ok is None and may_follow(previous, token)):
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
                last.append(token)
            before, ids, d = word, [], n
            while d:
                ids.append(last[d])
                d -= length_of[last[d]]
            ids.reverse()
            out[k] = ids
        if len(self.follows) > MEMO or len(self.texts) > MEMO:
            self._reset()
        return out

    def flat(self, words: list[bytes]) -> tuple[list[int], list[int]]:
        """The ids of all words behind each other, and how many each word has."""
        ids = self(words)
        return list(chain.from_iterable(ids)), list(map(len, ids))


class LibraryEncoder:
    """Encodes distinct words with the ``tokenizers`` library."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        # words are given to the file's model itself, in the alphabet that stands for bytes
        self.model = Tokenizer.from_file(path).model
        self.alphabet = np.zeros(256, "<u2")
        for c, b in byte_alphabet().items():
            self.alphabet[b] = ord(c)

    def _tokens(self, words: list[bytes]) -> list[list]:
        if not words:
            return []
        # a byte that no UTF-8 text holds, and that stands for itself, parts the words
        texts = self.alphabet[np.frombuffer(b"\xff".join(words), np.uint8)].tobytes().decode("utf-16-le").split("\xff")
        tokenize = self.model.tokenize
        return [tokenize(w) if w else [] for w in texts]

    def __call__(self, words: list[bytes]) -> list[list[int]]:
        return [[t.id for t in tokens] for tokens in self._tokens(words)]

    def flat(self, words: list[bytes]) -> tuple[list[int], list[int]]:
        """The ids of all words behind each other, and how many each word has."""
        found = self._tokens(words)
        return [t.id for tokens in found for t in tokens], list(map(len, found))


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """0 border, 1 letter, 2 number, 3 white space, 4 other, by code point."""
    table = np.full(0x110000, 4, np.uint8)
    everything = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "" for c in range(0x110000))
    for value, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, everything):
            table[m.start() : m.end()] = value
    table[0xD800:0xE000] = 0
    return table


BORDER = 0xD800


def word_starts(points: np.ndarray) -> np.ndarray:
    """Where words start in code points that begin and end with BORDER and have it between texts; a BORDER counts
    as a word of its own."""
    kind = char_classes()[points]
    start = np.empty(len(points), bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= kind == 0
    after = kind[1:]
    # of white space before a word, the last one is apart, and belongs to the word if it is a space
    last_space = np.flatnonzero((kind[:-1] == 3) & (after != 3) & (after != 0))
    start[last_space] = True
    start[last_space[points[last_space] == 32] + 1] = False
    quotes = np.flatnonzero((points == 39) & start)
    quotes = quotes[kind[quotes + 1] == 1]
    if len(quotes):
        one, two = points[quotes + 1], points[np.minimum(quotes + 2, len(points) - 1)]
        short = np.isin(one, [ord(c) for c in SHORT_1])
        long = np.zeros(len(quotes), bool)
        for a, b in SHORT_2:
            long |= (one == ord(a)) & (two == ord(b))
        start[quotes[short | long] + 1] = False
        start[quotes[long] + 2] = False
        start[quotes[short] + 2] = True
        start[quotes[long] + 3] = True
    return np.flatnonzero(start)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, ...]:
    """Powers of an odd number modulo 2^64, their inverses, and two random 64-bit values of each code point."""
    base, out = 0x9E3779B97F4A7C15, []
    for b in (base, pow(base, -1, 1 << 64)):
        x = np.full(2 * PIECE, b, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return *out, *np.random.default_rng(20).integers(0, 1 << 64, (2, 0x110000), np.uint64)


def word_keys(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit key of each word, and a second value that tells apart words of one key."""
    powers, inverses, values, others = _tables()
    ends = np.append(starts[1:], len(points))
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(values[points] * powers[: len(points)], out=total[1:])
    key = (total[ends] - total[starts]) * inverses[starts]
    np.cumsum(others[points], out=total[1:])
    return key, total[ends] - total[starts]


class TableEncoder:
    """Encodes lists of texts; remembers the ids of distinct words."""

    def __init__(self, path: str, encode_words=None):
        self.vocab = vocabulary(path)
        self.encode_words = encode_words or TrieEncoder(self.vocab)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.vocab.special, key=len, reverse=True)))) if self.vocab.special else None
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.second, self.flat, self.first, self.length = array("Q"), array("I"), array("q"), array("q")

    def __call__(self, texts: list[str]):
        """Yields the ids of each text, as uint32 arrays, in order."""
        block, size = [], 0
        for text in texts:
            if len(text) > PIECE or (self.special and self.special.search(text)):
                yield from self._encode(block)
                block, size = [], 0
                yield self._long(text)
                continue
            if size + len(text) + 1 > PIECE:
                yield from self._encode(block)
                block, size = [], 0
            block.append(text)
            size += len(text) + 1
        yield from self._encode(block)

    def _long(self, text: str) -> np.ndarray:
        """A text that holds special tokens, or one that is cut where a word surely starts: at a space between two
        characters that aren't white space."""
        out, at = [], 0
        for m in [*(self.special.finditer(text) if self.special else ()), None]:
            part = text[at : m.start() if m else len(text)]
            while len(part) > PIECE:
                cut = regex.compile(r"(?<=\S) (?=\S)").search(part, PIECE // 2)
                if not cut:
                    break
                out += self._encode([part[: cut.start()]])
                part = part[cut.start() :]
            out += self._encode([part])
            if m:
                out.append(np.array([self.vocab.special[m[0]]], np.uint32))
                at = m.end()
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        mark = chr(BORDER)
        points = np.frombuffer((mark + mark.join(texts) + mark).encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(points) >= 2 * PIECE:  # one endless word
            return [np.array(self.encode_words([t.encode()])[0] if len(word_starts(np.frombuffer((mark + t + mark).encode("utf-32-le", "surrogatepass"), np.uint32))) == 3 else np.concatenate([np.zeros(0, int), *(np.array(x) for x in self._plain(t))]), np.uint32) for t in texts]
        starts = word_starts(points)
        border = points[starts] == BORDER
        keys, checks = word_keys(points, starts)
        back, distinct = pd.factorize(keys)
        where = np.empty(len(distinct), np.int64)
        where[back[::-1]] = np.arange(len(back))[::-1]
        slots = self._slots(points, starts, distinct, where, checks)
        slot = slots[back]
        second = np.frombuffer(self.second, np.uint64)
        clash = np.flatnonzero((second[slot] != checks) & ~border)
        length, first = np.frombuffer(self.length, np.int64)[slot], np.frombuffer(self.first, np.int64)[slot]
        del second
        length[border] = 0
        if len(clash):  # two words of one key: one by one
            out = [np.array([i for w in self._plain(t) for i in w], np.uint32) for t in texts]
        else:
            total = np.cumsum(length)
            flat = np.frombuffer(self.flat, np.uint32)
            ids = flat[np.repeat(first - (total - length), length) + np.arange(total[-1])] if total[-1] else np.zeros(0, np.uint32)
            del flat
            out = np.split(ids, total[np.flatnonzero(border)[1:-1]])
        if len(self.known) > REMEMBERED:
            self._forget()
        return out

    def _plain(self, text: str) -> list[list[int]]:
        mark = chr(BORDER)
        starts = word_starts(np.frombuffer((mark + text + mark).encode("utf-32-le", "surrogatepass"), np.uint32))[1:] - 1
        return self.encode_words([text[a:b].encode() for a, b in zip(starts[:-1], starts[1:], strict=True)])

    def _slots(self, points, starts, distinct, where, checks) -> np.ndarray:
        found = np.fromiter(map(self.known.get, distinct.tolist(), repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(found < 0)
        if len(new):
            w = where[new]
            ends = np.append(starts[1:], len(points))
            # the new words behind each other, each after a border, as one text
            size = ends[w] - starts[w]
            total = np.cumsum(size + 1)
            spread = np.full(int(total[-1]), BORDER, np.uint32)
            inside = np.ones(len(spread), bool)
            inside[total - size - 1] = False
            spread[inside] = points[np.repeat(starts[w] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]
            mark = chr(BORDER).encode("utf-8", "surrogatepass")
            words = spread[1:].tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass").split(mark)
            if len(words) != len(new):  # a border is among them, as the empty word between two
                k = next(i for i, x in enumerate(w.tolist()) if points[starts[x]] == BORDER)
                del words[k : k + 1]
            ids, lengths = self.encode_words.flat(words)
            at, base, n = len(self.flat), len(self.first), np.array(lengths, np.int64)
            self.flat.frombytes(np.array(ids, np.uint32).tobytes())
            self.first.frombytes((at + np.cumsum(n) - n).tobytes())
            self.length.frombytes(n.tobytes())
            self.second.frombytes(checks[w].tobytes())
            found[new] = np.arange(base, base + len(new))
            self.known.update(zip(distinct[new].tolist(), range(base, base + len(new)), strict=True))
        return found


@lru_cache(maxsize=4)
def table_encoder(path: str, library: bool = False) -> TableEncoder:
    """A worker's encoder of a file: what it remembers serves all its tasks."""
    return TableEncoder(path, LibraryEncoder(path) if library else None)
