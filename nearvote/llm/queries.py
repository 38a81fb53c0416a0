"""Registered queries of the corpus operators: one per operator, and the parts of two that SQL can express."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearvote.llm import exact_dedup, hmm, html_text, jaccard_join, mixing, packing, pii, quality_rules, substring_dedup, url_filters
from nearvote.llm.common import documents


def labels(spark: SparkSession, sf_dir: str) -> DataFrame | None:
    """The labels, or None where there is no such table."""
    try:
        return spark.read.parquet(f"{sf_dir}/labels.parquet")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(documents(spark, sf_dir))

    def joined(kinds: tuple[str, ...]) -> Column:
        inside = F.filter("spans", lambda x: x["kind"].isin(*kinds))
        return F.array_join(F.transform(inside, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in pii.KINDS]
    return found.select("doc_id", *counts[:4], F.sha2(joined(pii.BASE), 256).alias("base_sha256"), joined(pii.KINDS).alias("spans"), *counts[4:], F.coalesce(F.array_max(F.transform("spans", lambda x: x["score"])), F.lit(0.0)).alias("max_score"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pack(documents(spark, sf_dir))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(documents(spark, sf_dir), labels(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op4_quality_rules`` that SQL can express."""
    return op4_quality_rules(spark, sf_dir).drop("kept", "rule")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(documents(spark, sf_dir))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op7_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.hmm_scores(documents(spark, sf_dir))


def language_model_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op7_hmm`` that SQL can express."""
    return op7_hmm(spark, sf_dir).drop("score").withColumn("base_score", F.round("base_score", 4))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.html_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(documents(spark, sf_dir))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OPERATORS = (op1_pii, op2_packing, op3_mixing, op4_quality_rules, op5_substring_dedup, op6_exact_dedup, op7_hmm, op8_html_extraction, op9_jaccard_join, op10_url_filters)
QUERIES = {f.__name__: f for f in (*OPERATORS, quality_base, language_model_base)}
ORACLES = {
    "op3_mixing": mixing.ORACLE,
    "op6_exact_dedup": exact_dedup.ORACLE,
    "op10_url_filters": url_filters.oracle(),
    "quality_base": quality_rules.ORACLE_BASE,
    "language_model_base": hmm.ORACLE_BASE,
}
