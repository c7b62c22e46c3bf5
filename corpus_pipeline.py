"""A training-data pipeline over documents, in five stages; each works on all that the one before kept.

1. quality: documents that the quality rules reject go.
2. near_duplicates: of each group of near copies one document stays.
3. repeated_passages: word windows that occur earlier are cut from the texts.
4. mix: documents are used as often as the mix of sources takes them.
5. tokens: each document's token ids are digested, and decoded again.

Empty tables pass through. Rows whose text is null or empty are rejected by the first stage. All columns of documents
stay up to the last stage, which returns doc_id, n_tokens, ids_sha256 and decoded_sha256.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sieveline.llm import bpe, mixing, quality, similar, substring_dedup
from sieveline.llm.staging import staged


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts go, with all that the rules reject."""
    return quality.accepted(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts are one group. Of equal rows one stays; of a group the smallest doc_id does, null last."""
    return similar.one_of_each_group(docs)


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts stay null; texts of which nothing is left stay as empty ones. Null doc_ids count as the largest."""
    return substring_dedup.without_repeats(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without words go. Equal rows are used as often as each other, to the nearest whole number for each."""
    return mixing.mixed_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts count as empty; every row is returned."""
    return bpe.round_trip_digests(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_passages", repeated_passage_stage),
    ("mix", mix_stage),
    ("tokens", token_stage),
]

#: SQL has neither XXH64 fingerprints nor the tokenizer: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
