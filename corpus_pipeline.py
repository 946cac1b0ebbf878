"""A corpus pipeline over ``documents``: language ID, near-duplicates, repeated strings, source mix, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colframe.llm import encoding, langid, minhash, mixing, repeats
from colframe.llm.queries import tokenizer_file
from colframe.llm.store import numbered, release, without, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bytes of a repeated string. A passage of more than 50 words of prose is longer than that; one of very short words, from
#: 101 bytes on, may be shorter, and stays then.
REPEATED_BYTES = 200


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language the model accepts; null texts and those without a letter go."""
    docs = docs.select(COLUMNS)
    return langid.predict(docs, langid.fit(docs), keep=COLUMNS).where("accepted").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class: that of the least id, nulls last, and of rows that share it any one. Rows have keys
    of their own, so ids may be null or repeat. Texts without words are no copies of others; of such rows that share id
    and text, one stays."""
    docs = docs.select(COLUMNS)
    worded = F.coalesce(F.col("text").rlike("[^ \\t\\n\\x0B\\f\\r]"), F.lit(False))
    rows = numbered(docs.where(worded), "rows")
    classes = minhash.classes(rows.select("row", F.col("doc_id").alias("key"), "text"))
    kept = without(rows, classes.where("row != best.row")).select(COLUMNS)
    release(classes)
    return kept.unionByName(docs.where(~worded).dropDuplicates(["doc_id", "text"]))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings of REPEATED_BYTES bytes that occur more than once out of all texts; a text of which nothing is left
    goes. Shorter strings stay, however many words they have."""
    cut = repeats.cut_texts(docs.select(COLUMNS), least=REPEATED_BYTES)
    return cut.where(F.coalesce(F.length("text"), F.lit(0)) > 0).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix of its source says: not at all, once or twice."""
    return mixing.apply_mix(docs.select(COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document that is left, with digests of them and of what they decode to."""
    return encoding.bpe_digests(docs, tokenizer_file())


STAGES = [("language_id", language), ("near_duplicates", near_duplicates), ("repeated_strings", repeated_strings), ("source_mix", source_mix), ("bpe", tokens)]

#: The stages learn a model, cut strings and follow hashes of links: not for SQL. Tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
