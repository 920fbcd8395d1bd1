"""A corpus pipeline of five stages, each one operator of pathweave.llm on all its predecessor kept.

Every stage but the last returns the columns of its documents; the last returns the packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pathweave.llm import group_join, language_id, packing, quality, secret_tags
from pathweave.llm.queries import tokenizer_file
from pathweave.session import materialise


#: Workers that have run four other stages have less memory left for a table of chunks.
TABLE_CHUNKS = 150_000


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or between two of them, go."""
    return language_id.accepted(docs, language_id.fit(docs))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or a certified cutoff go."""
    counted = materialise(quality.count_documents(docs), "counts")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.accepted(docs, quality.certified_cutoffs(counted, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at a similarity of 0.8 of five-word shingles one document stays."""
    return group_join.one_of_each(docs, 5, 4, 5)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts."""
    return secret_tags.redact(docs, secret_tags.fit(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack_documents(
        docs, tokenizer_file("word_bpe_49k.json"), table_chunks=TABLE_CHUNKS
    )


STAGES = [
    ("language_id", identify_languages),
    ("quality_rules", apply_quality_rules),
    ("jaccard_join", drop_near_copies),
    ("secret_scans", redact_secrets),
    ("best_fit_packing", pack_sequences),
]

#: The classifiers of the first and fourth stage have no SQL; tests hold run() against plain models.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
