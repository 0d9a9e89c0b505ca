"""The corpus queries: each applies its operator to whole tables and returns its full result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op1_language, op2_toxicity, op3_minhash, op4_suffix, op5_quality, op6_decontaminate, op7_tokens, op8_anchors, op9_html, op10_rules, op11_lines, op12_negatives, op13_clusters, sql
from .common import held_out, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    train = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    return op1_language.predict(docs.select("doc_id", held_out().alias("held_out"), "text"), train)


def op2_toxicity_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return op2_toxicity.score(docs, op2_toxicity.learned(docs, table(spark, sf_dir, "labels")))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_suffix.digests(table(spark, sf_dir, "documents"))


def op5_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return op5_quality.score(docs, op5_quality.learned(docs, table(spark, sf_dir, "labels")))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_tokens.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_anchors.digests(table(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_html.extract_pages(table(spark, sf_dir, "pages"))


def op6_decontaminate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_lines.digests(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_negatives.mined(table(spark, sf_dir, "embeddings"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_clusters.clustered(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_language_id, op2_toxicity_severity, op3_near_duplicates, op4_suffix_dedup, op5_quality_score, op6_decontaminate_report, op7_sentencepiece, op8_substring_dedup, op9_html_text, op10_quality_rules, op11_line_dedup, op12_hard_negatives, op13_centroid_clusters)}
ORACLE_SQL: dict[str, str] = {
    "op3_near_duplicates": sql.NEAR_DUPLICATES,
    "op4_suffix_dedup": sql.SUFFIX_DEDUP,
    "op6_decontaminate_report": op6_decontaminate.SQL,
    "op8_substring_dedup": sql.SUBSTRING_DEDUP,
    "op10_quality_rules": sql.quality_rules(op10_rules.CUTOFFS, op10_rules.BANDS, op10_rules.RISK, op10_rules.DELTA),
    "op11_line_dedup": op11_lines.SQL,
    "op12_hard_negatives": op12_negatives.SQL,
    "op13_centroid_clusters": op13_clusters.sql(),
}
