"""The corpus pipeline: toxicity, near-duplicates, secrets, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabloom.llm import mixing, packing, secrets, simhash, toxicity
from tabloom.llm.common import stage_table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go; the model learns from ``labels``.

    Null and empty texts score the leak and stay; equal texts stay or go together. Without
    labels of both kinds nothing goes."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class the document with the smallest id stays.

    Null, empty and blank texts are one class; of repeated rows one stays; rows with a null
    id are never copies and stay."""
    return simhash.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are replaced by a mark; every document stays, null and empty
    texts as they are, repeated rows each."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources get flatter weights; every document stays, small sources repeat some.

    A null source is a source; documents without a word come once; which documents of equal
    rank are repeated depends on their hashes alone."""
    return mixing.mix_whole(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens, packed. A null or empty text is one end token; each
    repeated row is packed. An empty table gives an empty result, here and in all stages."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A fitted model, a graph and a bin packing are beyond SQL; the stages are tested instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
