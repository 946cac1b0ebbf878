"""Language identification by averaged subword embeddings (operator 3).

A text is lowered; what isn't a letter is a space. Its subwords are runs of 2 to 4 characters without a space
inside, so those at a word's ends hold the space beside it. Each is hashed to a row of an embedding table; the
mean of a text's rows goes through a linear softmax. Both are trained in numpy by stochastic gradient descent on
a bounded sample of labelled rows. A temperature fitted on a held-back part of the sample makes the score a
probability; its targets are smoothed as in Platt scaling, else it would fall without end where no held-back text is
wrong, and all scores be 1. Rejection is a threshold on the score, one for each range of text lengths, as short texts
are less certain than long ones. A model of a single language has no score but 1 and rejects only texts without letters.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import char_classes
from .store import gives_back, limit_batches

BUCKETS, DIMENSION, SIZES = 1 << 14, 16, (2, 3, 4)
#: Code points that one round of array operations takes.
PIECE = 1 << 20
NO_LANGUAGE = "und"
#: Code points at which a training text is cut, and up to which a text counts as short, middling or (beyond all) long.
CUTS = (40, 200)
#: What a score may lie below its threshold, for sums in another order.
SLACK = 1e-6


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # by bucket: embedding, or with few languages what it adds to each logit
    head: np.ndarray | None  # embedding to logits, where the table holds embeddings
    bias: np.ndarray
    temperature: float
    least: np.ndarray  # by range of lengths: calibrated probability below which a text is rejected

    def scores(self, texts: list[str]) -> np.ndarray:
        """Calibrated probabilities, a row for each text; texts without subwords have equal ones."""
        if not self.languages:
            return np.zeros((len(texts), 0))
        x = text_means(texts, self.table)
        logits = ((x @ self.head if self.head is not None else x) + self.bias) / self.temperature
        p = np.exp(logits - logits.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def thresholds(self, texts: list[str]) -> np.ndarray:
        """The score that each text must reach."""
        return self.least[_lengths(texts)] - SLACK


def _lengths(texts: list[str]) -> np.ndarray:
    """The range of lengths of each text."""
    return np.searchsorted(CUTS, [len(t) for t in texts])


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> itself if it is a letter, else a space; 0 stays 0 and parts texts."""
    table = np.where(char_classes() == 1, np.arange(0x110000), 32).astype(np.uint32)
    table[0] = 0
    return table


def subwords(points: np.ndarray):
    """For each size: bucket of the subword that starts at each position, and whether there is one.

    ``points``: letters, spaces and 0 between texts."""
    x = points.astype(np.uint32)
    inner = x > 32
    for n in SIZES:
        count = len(x) - n + 1
        if count <= 0:
            continue
        h = np.full(count, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h ^= x[k : k + count]
            h *= np.uint32(0x01000193 + 2 * 0x5BD1E9)
            h ^= h >> np.uint32(15)
        ok = (x[:count] != 0) & (x[n - 1 :] != 0)
        if n == 2:
            ok &= inner[:count] | inner[1:]
        else:
            for k in range(1, n - 1):
                ok &= inner[k : k + count]
        yield (h >> np.uint32(32 - 14)).astype(np.int32), ok


def _points(texts: list[str]) -> np.ndarray:
    mark = "\0"
    joined = mark + mark.join(f" {t.lower()} ".replace(mark, " ") for t in texts) + mark
    return _letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]


def text_means(texts: list[str], table: np.ndarray) -> np.ndarray:
    """The mean of the table's rows over the subwords of each text. A long text is summed piece by piece, with
    the pieces' subwords overlapping by none."""
    out, block, size = [], [], 0
    for t in texts:
        if len(t) > PIECE:
            out += [_sums(block, table)] if block else []
            block, size = [], 0
            total = 0
            for at in range(0, len(t), PIECE):
                # subwords that start in a piece may end up to 3 characters behind it; they are counted there once
                total = total + _sums([t[at : at + PIECE + max(SIZES) - 1]], table, starts=PIECE + 1, skip=at > 0)
            out.append(total)
            continue
        if size + len(t) > PIECE:
            out.append(_sums(block, table))
            block, size = [], 0
        block.append(t)
        size += len(t) + 3
    out += [_sums(block, table)] if block else []
    sums = np.concatenate(out) if out else np.zeros((0, table.shape[1] + 1), np.float32)
    return sums[:, :-1] / np.maximum(sums[:, -1:], 1)


def _sums(texts: list[str], table: np.ndarray, starts: int = 0, skip: bool = False) -> np.ndarray:
    """Sums of rows, and in the last column their number. For a piece of a longer text, only subwords that start
    in its first ``starts`` positions count, the made-up space before it being one, but with ``skip`` none there."""
    points = _points(texts)
    edges = np.flatnonzero(points == 0)[:-1]
    out = np.zeros((len(texts), table.shape[1] + 1))
    for bucket, ok in subwords(points):
        if starts:
            ok[1 + starts :] = False
            if skip:
                ok[:2] = False
        at = np.minimum(edges, len(ok) - 1)
        for k in range(table.shape[1]):
            out[:, k] += np.add.reduceat(table[:, k][bucket] * ok, at)
        out[:, -1] += np.add.reduceat(ok.astype(np.int64), at)
    return out


def train(texts: list[str], languages: list[str], seed: int = 7, epochs: int = 4, least_steps: int = 400, batch: int = 64, rate: float = 40.0, reject: float = 0.002) -> Model:
    """SGD over short and long parts of the texts, ``epochs`` times over all or, of a small sample, ``least_steps`` steps.
    ``reject``: share of the held-back parts of a range of lengths, right or wrong, that the range's threshold would lose.
    With fewer parts than 1 / ``reject`` that is about the least score, which loses some more of other texts. A range without
    parts has the threshold of the one before, the first 0."""
    names = sorted(set(languages))
    if not names:
        return Model([], np.zeros((BUCKETS, 1), np.float32), None, np.zeros(0), 1.0, np.zeros(len(CUTS) + 1))
    number, rng = {x: i for i, x in enumerate(names)}, np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    held, used = order[: len(order) // 5], order[len(order) // 5 :]

    def parts(rows):
        for i in rows:
            t = texts[i]
            for a, b in zip((0, *CUTS), (*CUTS, None), strict=True):
                if t[a:b].strip() or a == 0:
                    yield t[a:b], number[languages[i]]

    def bags(rows):
        docs, labels = zip(*parts(rows), strict=True)
        points = _points(list(docs))
        doc_of = np.cumsum(points == 0) - 1
        keys = [doc_of[: len(ok)][ok].astype(np.int64) * BUCKETS + bucket[ok] for bucket, ok in subwords(points)]
        keys, counts = np.unique(np.concatenate(keys), return_counts=True)
        doc, bucket = keys // BUCKETS, (keys % BUCKETS).astype(np.int32)
        total = np.bincount(doc, counts, len(docs))
        return np.array(labels), np.searchsorted(doc, np.arange(len(docs) + 1)), bucket, counts / total[doc]

    emb = (rng.standard_normal((BUCKETS, DIMENSION)) / DIMENSION).astype(np.float32)
    head = (rng.standard_normal((DIMENSION, len(names))) / DIMENSION).astype(np.float32)
    bias = np.zeros(len(names), np.float32)

    def dense(span, rows):
        """The batch's buckets, and the share of each of them in each text."""
        spans = [slice(span[1][r], span[1][r + 1]) for r in rows]
        used, at = np.unique(np.concatenate([span[2][s] for s in spans]), return_inverse=True)
        x = np.zeros((len(rows), len(used)), np.float32)
        x[np.repeat(np.arange(len(rows)), [s.stop - s.start for s in spans]), at] = np.concatenate([span[3][s] for s in spans])
        return used, x

    def softmax(z):
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    data = bags(used) if len(used) else None
    steps = 0
    once = max(1, len(data[0]) // batch) if data else 1
    for _ in range(max(epochs, -(-least_steps // once)) if data else 0):
        for rows in np.array_split(rng.permutation(len(data[0])), once):
            buckets, x = dense(data, rows)
            mean = x @ emb[buckets]
            g = softmax(mean @ head + bias)
            g[np.arange(len(rows)), data[0][rows]] -= 1
            g /= len(rows)
            lr = rate / (1 + steps / 200)
            to_emb = x.T @ (g @ head.T)
            head -= lr * 0.02 * (mean.T @ g)
            bias -= lr * 0.02 * g.sum(0)
            emb[buckets] -= lr * to_emb
            steps += 1
    few = len(names) <= DIMENSION
    model = Model(names, np.asfortranarray(emb @ head) if few else emb, None if few else head, bias, 1.0, np.zeros(len(CUTS) + 1))
    check = list(parts(held if len(held) else used))
    if check:
        pieces, truth = [t for t, _ in check], np.array([k for _, k in check])
        z, own = np.log(np.maximum(model.scores(pieces), 1e-300)), np.eye(len(names), dtype=bool)[truth]
        miss = 1 / (len(truth) + 2)
        target = np.where(own, 1 - miss, miss / max(1, len(names) - 1))
        grid = np.geomspace(0.05, 20, 61)
        loss = [-(target * _log_softmax(z / t)).sum(1).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        p = model.scores(pieces)
        band, best = _lengths(pieces), p.max(1)
        for k in range(len(CUTS) + 1):
            held_scores = best[band == k]
            model.least[k] = np.quantile(held_scores, reject) if len(held_scores) else model.least[max(0, k - 1)]
    return model


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def in_fold(key: Column, fold: int, folds: int) -> Column:
    """True if crc32 of the id as text is ``fold`` modulo ``folds``; false for a null id."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))


def training_sample(df: DataFrame, id_col: str, text_col: str, lang_col: str, most: int, window: int) -> list:
    """At most about ``most`` labelled rows, equally many of each language, chosen by hash of the id; of each a
    window of ``window`` characters at a place that the hash chooses. Memory on the driver is bounded by both."""
    labelled = df.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    sizes = {r[0]: r[1] for r in labelled.groupBy(F.col(lang_col)).count().collect()}
    if not sizes:
        return []
    each = max(20, most // len(sizes))
    chance = F.coalesce(*[F.when(F.col(lang_col) == k, F.lit(min(1.0, each / n))) for k, n in sorted(sizes.items())])
    h = F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(1 << 30))
    at = F.pmod(F.xxhash64(F.col(id_col), F.lit(12)), F.greatest(F.lit(1), F.length(text_col) - window)).cast("int") + 1
    rows = labelled.where(h < chance * float(1 << 30)).select(F.col(id_col), F.substring(F.col(text_col), at, F.lit(window)), F.col(lang_col)).collect()
    return sorted((tuple(r) for r in rows), key=repr)


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = 4000, window: int = 1000, fold: int | None = 2, folds: int = 4) -> Model:
    """A model of the languages in ``lang_col``, from rows outside ``fold`` only. Rows with a null language, or a
    text that is null or has no letter, teach nothing; without any other row there are no languages."""
    usable = df.select(F.col(id_col), F.col(text_col), F.col(lang_col))
    if fold is not None:
        usable = usable.where(~in_fold(F.col(id_col), fold, folds) & F.col(id_col).isNotNull())
    rows = training_sample(usable, id_col, text_col, lang_col, most, window)
    return train([r[1] for r in rows], [r[2] for r in rows])


def predict(df: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns of ``df`` (default all) with ``lang_pred``, ``score`` and ``accepted``, from the whole
    text alone. A text that is null or has no letter is ``und`` with score 0, and so is every text if the model has no
    languages; those, and texts whose score is below the model's threshold for their length, aren't accepted."""
    spark = df.sparkSession
    limit_batches(spark)
    names = keep if keep is not None else df.columns
    source = df.select(F.col(text_col).cast("string").alias("t"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    shared = spark.sparkContext.broadcast(model)
    schema = source.select("row").schema.add("lang_pred", "string").add("score", "double").add("accepted", "boolean")

    def run(batches):
        model, letter = shared.value, _letters()
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            p = model.scores(texts)
            known = [bool(model.languages) and _has_letter(t, letter) for t in texts]
            best = p.argmax(1) if model.languages else np.zeros(len(texts), int)
            lang = [model.languages[b] if k else NO_LANGUAGE for b, k in zip(best, known, strict=True)]
            score = [float(p[i, b]) if k else 0.0 for i, (b, k) in enumerate(zip(best, known, strict=True))]
            accepted = np.array(known, bool) & (np.array(score) >= model.thresholds(texts))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted)], names=["row", "lang_pred", "score", "accepted"])

    return source.mapInArrow(gives_back(run), schema).select("row.*", "lang_pred", "score", "accepted")


def _has_letter(text: str, letter: np.ndarray) -> bool:
    for at in range(0, len(text), 4096):
        if (letter[np.frombuffer(text[at : at + 4096].encode("utf-32-le", "surrogatepass"), np.uint32)] > 32).any():
            return True
    return False


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fold: int = 2, folds: int = 4) -> DataFrame:
    """``id_col, held_out, lang_pred, score, accepted`` for each row; trained outside the held-out fold.
    A null id isn't held out and teaches nothing."""
    model = fit(df, id_col, text_col, lang_col, fold=fold, folds=folds)
    out = predict(df, model, text_col, [id_col])
    return out.select(F.col(id_col), in_fold(F.col(id_col), fold, folds).alias("held_out"), "lang_pred", "score", "accepted")
