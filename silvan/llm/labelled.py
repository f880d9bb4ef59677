"""Bounded samples of labelled documents, for fitting classifiers on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold


def sample(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, rows: int) -> list[tuple[bytes, int]]:
    """(text, label) of at most `rows` labelled documents, drawn by a hash of doc_id, in a fixed order.

    Rows of the held-out fold (crc32 of doc_id mod folds = held) never come in. Only the labels drawn (at most `rows`)
    are broadcast. Texts that repeat come in once with each label; documents without label, and labels without
    document or value, are left out.
    """
    drawn = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held))
    drawn = drawn.select(F.col("doc_id").cast("long").alias("label_id"), F.col(label).cast("int").alias("label")).orderBy(F.xxhash64("label_id"), "label_id").limit(rows)
    found = docs.join(F.broadcast(drawn), F.col("doc_id").cast("long") == F.col("label_id")).select("label_id", F.coalesce("text", F.lit("")).alias("text"), "label").toArrow()
    picked = sorted(zip(found["label_id"].to_pylist(), found["text"].to_pylist(), found["label"].to_pylist(), strict=True))
    return [(text.encode(), y) for text, y in dict.fromkeys((text, y) for _, text, y in picked)]
