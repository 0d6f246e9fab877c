"""The corpus pipeline: language ID, exact dedup, near dedup, mixing to target weights, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkmere.llm import bpe, exact_dedup, language_id, mixing, near_dedup


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language is recognised go: null texts, texts without a letter, and those whose pooled probability of the best language is hardly
    above chance (language_id.MIN_LIFT). Where no language is given all go; an empty table stays empty."""
    return language_id.recognised_documents(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text, white space made single, the one of the smallest doc_id stays, null doc_ids last."""
    return exact_dedup.kept_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the smallest doc_id, null doc_ids last. Documents without words are near to nothing."""
    return near_dedup.kept_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes, with all columns. A null source is a source; rows equal in every column stand for each other, others don't."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; null and empty texts have no ids, repeated rows stay repeated."""
    return bpe.encoding_digest(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Rows that reach Python at a time, so that no executor holds many texts twice.
ROWS = 1_000

#: Minima of universal hashes, a trained network and a vocabulary can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each result but the last is written to the shared checkpoint folder and read from there."""
    from sparkmere.llm.common import arrow_rows, documents, saved

    docs = documents(spark, sf_dir)
    with arrow_rows(spark, ROWS):
        for _, stage in STAGES[:-1]:
            docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
