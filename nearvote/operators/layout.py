"""Partition keys, sorted layout, blocks and their bounds."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearvote.config import BLOCK_ROWS, PARTITION_ABOVE, PARTITION_DIMS, PARTITIONS, SORT_DIMS
from nearvote.functions.features import Q


def partition_key() -> Column:
    """8 bits, one for each of the dimensions that exceeds one half."""
    return reduce(add, ((F.col(Q[d]) > PARTITION_ABOVE).cast("int") * (1 << b) for b, d in enumerate(PARTITION_DIMS)))


def lay_out(vectors: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Adds pkey, pos (place in the whole layout) and block (within pkey).

    Rows are numbered within (pkey, q8, q1), the head of the sort order, and
    moved by the counts of the groups before, so no partition sorts the whole
    table and one frequent key is still dealt out by its q8 and q1.
    """
    first, second, *rest = (Q[d] for d in SORT_DIMS)
    keyed = vectors.withColumn("pkey", partition_key())
    counts = keyed.groupBy("pkey", F.col(first).alias("lead"), F.col(second).alias("next")).agg(F.count("*").alias("n"))
    all_before = W.orderBy("pkey", "lead", "next").rowsBetween(W.unboundedPreceding, -1)
    own_before = W.partitionBy("pkey").orderBy("lead", "next").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    starts = counts.select(F.col("pkey").alias("k"), "lead", "next", F.coalesce(F.sum("n").over(all_before), zero).alias("start"), F.coalesce(F.sum("n").over(own_before), zero).alias("within"))
    row = F.row_number().over(W.partitionBy("pkey", first, second).orderBy(*rest, row_id)) - 1
    same_group = (F.col("pkey") == F.col("k")) & (F.col(first) == F.col("lead")) & (F.col(second) == F.col("next"))
    placed = keyed.withColumn("row", row).join(starts, same_group)
    block = F.floor((F.col("within") + F.col("row")) / BLOCK_ROWS).cast("long")
    return placed.withColumn("pos", F.col("start") + F.col("row")).withColumn("block", block).drop("k", "lead", "next", "start", "within", "row")


def partition_offsets(vectors: DataFrame) -> DataFrame:
    """Rows, first row and first block of each of the 256 partitions."""
    spine = vectors.sparkSession.range(PARTITIONS).select(F.col("id").cast("int").alias("pkey"))
    n = vectors.select(partition_key().alias("pkey")).groupBy("pkey").agg(F.count("*").alias("n"))
    full = spine.join(n, "pkey", "left").select("pkey", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    before = W.orderBy("pkey").rowsBetween(W.unboundedPreceding, -1)
    blocks = F.ceil(F.col("n") / BLOCK_ROWS)
    start = lambda x: F.coalesce(F.sum(x).over(before), F.lit(0)).cast("long")
    return full.select("pkey", "n", start("n").alias("row_offset"), start(blocks).alias("block_offset"))


def block_bounds(laid_out: DataFrame) -> DataFrame:
    """Zone map: least and greatest value per dimension of every block."""
    return laid_out.groupBy("pkey", "block").agg(*(F.min(q).alias(f"min{d}") for d, q in enumerate(Q)), *(F.max(q).alias(f"max{d}") for d, q in enumerate(Q)), F.count("*").alias("n"))


def rows_at(laid_out: DataFrame, *positions: int) -> DataFrame:
    """Rows by position."""
    return laid_out.where(F.col("pos").isin(*positions))


def rows_of_partition(laid_out: DataFrame, pkey: int, block: int | None = None) -> DataFrame:
    """Rows of a partition, or of one of its blocks; a filter that prunes files."""
    rows = laid_out.where(F.col("pkey") == pkey)
    return rows if block is None else rows.where(F.col("block") == block)
