"""Corpus pipeline: from raw documents to packed training sequences.

Quality rules, exact dedup, n-gram Jaccard join, mixing to target weights and
best-fit packing. Each stage works on all that the one before kept; all but
the last return the columns of ``documents``.

Defined cases, besides those of the operators: a doc_id names a document, so
rows with the same doc_id stand or fall together in the Jaccard stage; in the
exact stage, of rows with equal doc_id and equal text one stays; a null doc_id
is dropped where an equal or near text has an id, and stays else; the mixing
stage repeats a row as often as the mix takes it and drops rows not taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearvote.llm import exact_dedup, jaccard_join, mixing, packing, quality_rules
from nearvote.llm.common import SPACE, materialize, settle, text_or_empty, whole_row, without
from nearvote.llm.queries import labels


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.where(quality_rules.quality_rules(docs, labels(spark, sf_dir)), F.col("kept")).select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the smallest id."""
    judged = settle(exact_dedup.exact_dedup(docs))
    again = judged.where("kept").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    mixed = judged.groupBy("doc_id").agg(F.min("kept").alias("lo"), F.max("kept").alias("hi")).where("lo <> hi")
    if again.isEmpty() and mixed.isEmpty():
        return without(docs, judged.where(~F.col("kept")))
    # Some doc_id has several rows: decide by id and text.
    sha = F.sha2(F.regexp_replace(text_or_empty(), SPACE, " "), 256)
    kept = judged.where("kept").select(F.col("doc_id").alias("k"), F.col("text_sha256").alias("s")).distinct()
    row = docs.select(whole_row(docs), F.col("doc_id").cast("long").alias("id"), sha.alias("sha"))
    stay = row.join(kept, F.col("id").eqNullSafe(F.col("k")) & (F.col("sha") == F.col("s")), "left_semi")
    return stay.dropDuplicates(["id", "sha"]).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near texts, the one with the smallest id."""
    found = jaccard_join.jaccard_components(docs)
    return without(docs, found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.take(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in training sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", keep_quality),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Learned rules, the tokenizer and bin completion are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
