"""The corpus pipeline: five stages from raw documents to packed sequences.

Of every stage: an empty table gives an empty one; null and empty texts are documents like others (equal to each other without
blanks, linked with nothing, without secrets, one token long); rows without doc_id are told apart by their texts alone;
repeated rows are exact copies; columns beyond those of documents pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from silvan.llm import exact_dedup, ngram_join, packing, queries, secret_scan, toxicity
from silvan.llm.common import cut, documents, drop_since, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity field rejects go. It learns from the labelled documents of its input."""
    return toxicity.without_toxic(docs, queries.toxicity_model(spark, docs, sf_dir))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal without blanks, the longest stays."""
    return exact_dedup.deduplicate(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents, the one with the smallest doc_id stays; rows without doc_id all stay."""
    return ngram_join.one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return secret_scan.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become pieces of packed sequences."""
    return packing.pack(docs, queries.VOCABULARY, queries.RANKS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact),
    ("ngram_join", drop_near),
    ("secret_scan", mask_secrets),
    ("packing", pack),
]

#: SQL expresses neither the toxicity field nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. What each one returns is written to the shared folder and read again by the next;
    the tables before it are then deleted."""
    docs, before = documents(spark, sf_dir), written()
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
            drop_since(before, docs)
    return docs
