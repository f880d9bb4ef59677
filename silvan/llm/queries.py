"""The queries of this subpackage, as __spark_entry__.py registers them, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, brown_lm, exact_dedup, labelled, licenses, media, ngram_join, packing, quality, secret_scan, toxicity
from .common import documents

#: The public tokenizer's vocabulary, and the same as a rank file.
VOCABULARY, RANKS = str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(documents(spark, sf_dir), VOCABULARY)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = labelled.sample(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", quality.FOLDS, quality.HELD, quality.SAMPLE)
    return quality.scored(docs, quality.fit(rows))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), VOCABULARY, RANKS)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(documents(spark, sf_dir))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(documents(spark, sf_dir))


def op7_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.scores(documents(spark, sf_dir))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Field:
    return toxicity.fit(labelled.sample(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic", toxicity.FOLDS, toxicity.HELD, toxicity.SAMPLE))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.scored(docs, toxicity_model(spark, docs, sf_dir))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_bpe, op2_quality, op3_packing, op4_exact_dedup, op5_ngram_join, op6_secrets, op7_brown_lm, op8_licenses, op9_toxicity, op10_media)}

ORACLE_SQL: dict[str, str] = {
    "op5_ngram_join": """
        WITH RECURSIVE w AS (
          SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents
        ), s AS (
          SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i+3], ' ')) END) AS shingle FROM w
        ), n AS (
          SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), p AS (
          SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS hits FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
        ), l AS (
          SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * hits >= 85 * (x.n + y.n - hits)
        ), r(doc_id, reach) AS (
          SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reach = l.a
        )
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
        FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(reach) AS c FROM r GROUP BY doc_id) m USING (doc_id)""",
    "op4_exact_dedup": """
        WITH d AS (
          SELECT doc_id, length(coalesce(text, '')) AS n_cp, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') AS norm FROM documents
        ), k AS (
          SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_cp DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k""",
}
