"""A corpus pipeline of five stages, each on all that the one before kept, written and read again between stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scriptloom.llm import bpe, decontam, langid, neardup, toxicity
from scriptloom.llm.common import release, stored, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, null texts among them, or in no language that can be told, go.

    The languages are learned from the documents themselves, by their non-null ``lang``; if none has one, all go.
    Repeated rows are judged alike. No documents give none.
    """
    return langid.keep_known(docs)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go, whatever their labels.

    Learned from the ``labels`` of documents that are still there; without any, all stay. Null texts are judged as empty ones, repeated rows
    alike. No documents give none.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word similarity of 0.8 or more) one document stays: that with the smallest doc_id.

    Of rows of that id, the one whose text has the smallest hash. Null ids come last. Texts without words, nulls among
    them, are one group. No documents give none.
    """
    return neardup.drop_similar(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, repeated rows each; null texts stay. No items let all stay."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row; a null text is empty. No documents give no rows."""
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("toxicity", not_toxic),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminated),
    ("byte_bpe", tokenized),
]

#: SQL can't express the stages; tests/llm compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        last, docs = docs, stored(stage(spark, docs, sf_dir))
        release(last)
    return docs
