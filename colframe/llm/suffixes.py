"""The corpus order of some byte strings by prefix-free parsing: suffix arrays of dictionary and parse, combined.

A rolling hash over TRIGGER bytes cuts each text into phrases, which end with a trigger and overlap by it, so that no
suffix of a phrase that is longer than a trigger is a prefix of another phrase's. The dictionary holds each distinct phrase once;
the parse is the texts as phrase numbers, in the order of the phrases. Suffixes of either get ranks by prefix doubling, those of the
dictionary only in phrases with places that are asked for. A place of a text is ordered by the rank of what is left of its phrase
and then by the rank of the parse behind that phrase.
"""

from __future__ import annotations

import numpy as np

from .shingles import mixed

#: Bytes of a trigger; one place in EACH is one, by chance.
TRIGGER, EACH = 6, 48
#: Bytes that the first ranks of the dictionary's suffixes compare, 9 bits for each.
FIRST = 4
#: Pairs of strings compared at once.
COMPARED = 4096


def triggers(data: np.ndarray) -> np.ndarray:
    """Whether a trigger begins at each place but the last TRIGGER - 1."""
    n = max(0, len(data) - TRIGGER + 1)
    h = np.zeros(n, np.uint64)
    for k in range(TRIGGER):
        h = (h << np.uint64(8)) | data[k : k + n]
    return mixed(h) % np.uint64(EACH) == 0


def parse(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """The dictionary, and of all phrases, those of a text after the other: number, start in the joined texts, and text."""
    at = triggers(np.frombuffer(b"".join(texts), np.uint8))
    found, numbers, begin, of, dictionary, tails, first = np.flatnonzero(at), [], [], [], {}, {}, 0
    words: list[bytes] = []
    for i, text in enumerate(texts):
        last = first + len(text)
        a, b = np.searchsorted(found, (first + 1, last - TRIGGER + 1))
        cuts = [0, *(found[a:b] - first).tolist()]
        for start, end in zip(cuts, [*cuts[1:], None], strict=True):
            # the last phrase of a text ends with the text, not with a trigger
            phrase, known = (text[start:], tails) if end is None else (text[start : end + TRIGGER], dictionary)
            number = known.get(phrase)
            if number is None:
                number = known[phrase] = len(words)
                words.append(phrase)
            numbers.append(number)
            begin.append(first + start)
            of.append(i)
        first = last
    return words, np.array(numbers, np.int64), np.array(begin, np.int64), np.array(of, np.int64)


def _sorted(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of some numbers of ``bits`` bits in their order, and the numbers in it."""
    own = len(key).bit_length()
    if bits + own <= 63:  # sorting numbers alone is much faster than sorting places by them
        both = np.sort(key << own | np.arange(len(key)))
        return both & ((1 << own) - 1), both >> own
    order = np.argsort(key, kind="stable")
    return order, key[order]


def _first(values: np.ndarray) -> np.ndarray:
    """For each of some sorted numbers, where the first equal one is."""
    new = np.append(True, values[1:] != values[:-1])
    return np.maximum.accumulate(np.where(new, np.arange(len(values)), 0))


def _ranks(key: np.ndarray, bits: int, end: np.ndarray, k: int, most: int) -> np.ndarray:
    """Ranks of all places by ``most`` symbols at least, from numbers that order them by ``k``: how many are below. ``end`` is the place of
    the end mark behind each place, which is below all other symbols."""
    rank = np.empty(len(key), np.int64)
    order, values = _sorted(key, bits)
    rank[order] = first = _first(values)
    size = len(key).bit_length()
    tied = np.diff(np.append(np.flatnonzero(first == np.arange(len(first))), len(first)))
    open_ = np.sort(order[np.repeat(tied > 1, tied)])
    while k < most and len(open_):
        order, values = _sorted(rank[open_] << size | rank[np.minimum(open_ + k, end[open_])], 2 * size)
        first, group = _first(values), _first(values >> size)
        rank[open_[order]] += first - group
        tied = np.diff(np.append(np.flatnonzero(first == np.arange(len(first))), len(first)))
        left = open_[order[np.repeat(tied > 1, tied)]]
        # at their end, ties stay so
        open_, k = np.sort(left[left + 2 * k <= end[left]]), 2 * k
    return rank


def dictionary_ranks(words: list[bytes], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of all suffixes of the phrases by ``most`` bytes at least, and where each phrase begins; an end mark follows it."""
    length = np.array([len(w) + 1 for w in words], np.int64)
    begin = np.cumsum(length) - length
    symbol = np.frombuffer(b"\0".join(words) + b"\0", np.uint8).astype(np.int64) + 1
    symbol[begin + length - 1] = 0
    end = np.repeat(begin + length - 1, length)
    at, key = np.arange(len(symbol)), np.zeros(len(symbol), np.int64)
    for k in range(FIRST):
        key = key << 9 | symbol[np.minimum(at + k, end)]
    return _ranks(key, 9 * FIRST, end, FIRST, most), begin


def parse_ranks(phrases: np.ndarray, of: np.ndarray, texts: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of all suffixes of the parse by ``most`` phrases at least, each text's followed by an end mark, and the place of each
    phrase there."""
    place = np.arange(len(phrases)) + of
    last = np.cumsum(np.bincount(of, minlength=texts) + 1) - 1
    symbol = np.zeros(len(phrases) + texts, np.int64)
    symbol[place] = phrases + 1
    return _ranks(symbol, int(symbol.max()).bit_length(), np.repeat(last, np.diff(last, prepend=-1)), 1, most), place


def corpus_order(texts: list[bytes], places: np.ndarray, most: int) -> np.ndarray:
    """``places`` of the joined texts in the order of what follows them in their texts, as far as ``most`` bytes; of equal strings,
    in any order."""
    words, numbers, begin, of = parse(texts)
    order = np.empty(len(words), np.int64)
    order[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    rest, where = parse_ranks(order[numbers], of, len(texts), most)
    phrase = np.searchsorted(begin, places, "right") - 1
    asked, own = np.unique(numbers[phrase], return_inverse=True)
    suffix, head = dictionary_ranks([words[i] for i in asked.tolist()], most)
    key = suffix[head[own] + places - begin[phrase]] << len(rest).bit_length() | rest[where[phrase] + 1]
    return places[_sorted(key, len(suffix).bit_length() + len(rest).bit_length())[0]]


def repeated(texts: list[bytes], starts: np.ndarray, least: int) -> np.ndarray:
    """Whether the string of ``least`` bytes at each start, in the first ``starts`` places of each text, is at another of these starts:
    neighbours in the corpus order are compared."""
    length = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(length) - length
    of = np.repeat(np.arange(len(texts)), starts)
    places = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(starts) - starts, starts)
    out = np.zeros(int(length.sum()), bool)
    if len(places) > 1:
        order = corpus_order(texts, places, least)
        data = np.frombuffer(b"".join(texts), np.uint8)
        windows = np.lib.stride_tricks.sliding_window_view(data, least)
        a, b = order[:-1], order[1:]
        for k in (0, least // 2, least - 1):
            same = data[a + k] == data[b + k]
            a, b = a[same], b[same]
        for at in range(0, len(a), COMPARED):
            x, y = a[at : at + COMPARED], b[at : at + COMPARED]
            same = (windows[x] == windows[y]).all(1)
            out[x[same]] = out[y[same]] = True
    return out[places]
