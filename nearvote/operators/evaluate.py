"""Approximate against exact votes, and readiness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearvote.config import DENY_VOTES, EVALUATION_FIRST, EVALUATION_QUERIES, READY_ROWS
from nearvote.functions.features import Q


def systematic_sample(laid_out: DataFrame, n: int, queries: int = EVALUATION_QUERIES, first: int = EVALUATION_FIRST) -> DataFrame:
    """Rows ``first + i * (n / queries)`` of the layout as queries."""
    step = max(1, n // queries)
    at = F.col("pos") - first
    return laid_out.where((at >= 0) & (at % step == 0) & (at < step * queries)).select(F.col("pos").alias("qid"), *Q)


def accuracy(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """One row: a query with equal votes counts 1, any other one half; a mismatch
    is a query that one side denies (``DENY_VOTES`` or more) and the other not."""
    both = exact.select("qid", F.col("votes").alias("e")).join(approximate.select("qid", F.col("votes").alias("a")), "qid")
    missed = ((F.col("e") >= DENY_VOTES) != (F.col("a") >= DENY_VOTES)).cast("int")
    return both.agg(
        F.count("*").alias("queries"),
        F.round(100 * F.avg(F.when(F.col("e") == F.col("a"), 1.0).otherwise(0.5)), 4).alias("vote_match_pct"),
        F.sum(missed).alias("mismatches"),
        F.round(100 * F.avg(missed), 4).alias("mismatch_pct"),
        F.round(F.avg("e"), 4).alias("avg_exact"),
        F.round(F.avg("a"), 4).alias("avg_ivf"),
    )


def ready(table: DataFrame, rows: int = READY_ROWS) -> DataFrame:
    """Whether there are enough rows to vote; reads no more than it needs."""
    return table.select("label").limit(rows).agg((F.count("*") >= rows).alias("ready"))
