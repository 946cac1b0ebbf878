"""BPE encoding and decoding of whole text columns (operator 10)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import table_encoder, vocabulary
from .store import limit_batches


def map_ids(df: DataFrame, tokenizer: str, id_col: str, text_col: str, columns: dict[str, str], finish: Callable[[np.ndarray, list[bytes]], tuple], library: bool = False) -> DataFrame:
    """One row for each row of ``df``: its id, and what ``finish(ids, bytes_of)`` makes of the text's token ids.

    ``columns`` gives names and Spark types of what ``finish`` returns. A text is encoded whole; null counts as
    empty, and has no ids. Rows are independent, so repeated rows and ids give repeated results. Memory is bounded
    by one batch, the longest text and a fixed number of remembered words.
    """
    limit_batches(df.sparkSession)
    schema = df.select(F.col(id_col)).schema
    for name, kind in columns.items():
        schema = schema.add(name, T.DataType.fromDDL(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        encode, bytes_of = table_encoder(tokenizer, library), vocabulary(tokenizer).bytes_of
        arrow = to_arrow_schema(schema)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = [finish(ids, bytes_of) for ids in encode(texts)]
            made = zip(*rows, strict=True) if rows else [[] for _ in columns]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field(0).type), *(pa.array(list(x), arrow.field(i + 1).type) for i, x in enumerate(made))], schema=arrow)

    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def bpe_encode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids`` (array<int>): the text's token ids. An empty or null text has an empty array."""
    return map_ids(df, tokenizer, id_col, text_col, {"ids": "array<int>"}, lambda ids, _: (ids.astype(np.int32),))


def bpe_decode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``text``: what the ids stand for, special tokens included. Bytes that aren't UTF-8 become
    U+FFFD; null ids give an empty text; an id outside the vocabulary stands for nothing."""
    limit_batches(df.sparkSession)
    schema = df.select(F.col(id_col)).schema.add("text", "string")

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, bytes_of = to_arrow_schema(schema), vocabulary(tokenizer).bytes_of
        for batch in batches:
            texts = [decoded(x or [], bytes_of) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field(0).type), pa.array(texts, arrow.field(1).type)], schema=arrow)

    return df.select(F.col(id_col), F.col(ids_col).cast("array<int>")).mapInArrow(run, schema)


def decoded(ids: list[int], bytes_of: list[bytes]) -> str:
    n = len(bytes_of)
    return b"".join([bytes_of[i] for i in ids if i is not None and 0 <= i < n]).decode("utf-8", "replace")


def digests(ids: np.ndarray, bytes_of: list[bytes]) -> tuple:
    """Number and digest of the ids, and the digest of what they decode to."""
    text = b"".join(map(bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")
    return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def bpe_digests(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens, ids_sha256, decoded_sha256``: encoding and decoding in one pass over the texts."""
    return map_ids(df, tokenizer, id_col, text_col, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}, digests)
