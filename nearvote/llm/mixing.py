"""Mixing sources to target weights by hash-threshold histograms, all native.

Sizes are words. Source targets share a budget by weight; none may exceed
``max_epochs`` times its source, and what it cannot use is shared again by
weight among the others. A source's copies are nested budgets: ``floor(target /
size)`` whole passes take every document, and the rest of the target takes the
documents whose hash lies below a threshold, so a larger budget only ever adds
documents.

The threshold is found without sorting documents: sum sizes by source and
hash bucket (4096 buckets), find the bucket in which the running sum crosses
the budget, and refine that bucket alone by the next 12 bits of the hash, five
times, until a bucket is one hash value. Each histogram has at most 4096 rows
per source, summed before the shuffle, so a source with a third of all rows
costs no more than another. Documents are then filtered by comparing hashes.

Defined cases: a null text has size 0; a null source is a source of its own,
the last; a source of size 0 has target 0; a null doc_id hashes like an empty
id; rows with the same doc_id share a hash and are taken together; an empty
table gives an empty result; columns other than doc_id, text and source are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearvote.llm.common import BROADCAST_IDS, WORD, discard, materialize, text_or_empty, whole_row

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
BITS, LEVELS = 12, 5


def hash_of(name: str) -> Column:
    """60 bits of the md5 of an id."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(name).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, and a hash of 60 bits of the doc_id."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"),
        hash_of("doc_id").alias("hash"),
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target: one row per source.

    Water filling in closed form: by rising ``max_epochs * size / weight``,
    sources are capped until the level that the rest would get fits under
    their own cap. The windows run over the table of sources alone.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("long")
    ranked = per.select("source", "source_size", weight.alias("weight"))
    cap = max_epochs * F.col("source_size")
    order = W.orderBy((cap.cast("double") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    filled = ranked.select(
        "*",
        F.row_number().over(order).alias("k"),
        (F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))).alias("budget_left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weight_left"),
    ).withColumn("level", F.col("budget_left").cast("double") / F.col("weight_left"))
    open_ = F.when(F.col("level") * F.col("weight") <= cap, F.struct("k", "level"))
    first = filled.withColumn("first", F.min(open_).over(everything))
    capped = F.col("first").isNull() | (F.col("k") < F.col("first.k"))
    return first.select("source", "source_size", F.when(capped, cap.cast("double")).otherwise(F.col("first.level") * F.col("weight")).alias("target"))


def _rest(size: Column, target: Column) -> tuple[Column, Column]:
    passes = F.when(size > 0, F.floor(target / size)).otherwise(F.lit(0)).cast("long")
    return passes, target - passes * size


def thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: the last hash taken once more, and the passes before.

    A document is taken ``passes`` times, and once more if its hash is at most
    ``cut``. Each level's boundaries (a row per source) are written, so that a
    level's plan reads them instead of holding all levels before it.
    """
    passes, rest = _rest(F.col("source_size"), F.col("target"))
    # at: the high bits of the boundary bucket so far; done: the sum below it.
    edge = materialize(targets.select("source", "source_size", "target", passes.alias("passes"), rest.alias("rest"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("done")))
    few = edge.count() <= BROADCAST_IDS
    by_source = F.broadcast if few else lambda table: table
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        bucket = F.shiftright("hash", shift)
        known = by_source(edge.select(F.col("source").alias("s"), F.col("at").alias("above")))
        inside = sizes if level == 1 else sizes.join(known, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("hash", shift + BITS) == F.col("above"))).select("source", "size", "hash")
        histogram = inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words")).withColumnRenamed("source", "hs")
        joined = histogram.join(by_source(edge), F.col("hs").eqNullSafe(F.col("source")))
        by = W.partitionBy("source").orderBy("bucket")
        running = joined.withColumn("through", F.col("done") + F.sum("words").over(by))
        # The first bucket whose running sum reaches the rest; else the last one.
        crossing = F.min(F.when(F.col("through") >= F.col("rest"), F.struct("bucket", "words", "through"))).alias("c")
        last = F.max(F.struct("bucket", "words", "through")).alias("l")
        picked = running.groupBy("source", "source_size", "target", "passes", "rest").agg(crossing, last)
        b = F.coalesce(F.col("c"), F.col("l"))
        step = materialize(picked.select("source", "source_size", "target", "passes", "rest", b["bucket"].alias("at"), (b["through"] - b["words"]).alias("done"), b["through"].alias("through")))
        discard(edge)
        edge = step
    nearer = F.abs(F.col("through") - F.col("rest")) < F.abs(F.col("done") - F.col("rest"))
    cut = F.when(nearer, F.col("at")).otherwise(F.col("at") - 1)
    return edge.select(F.col("source").alias("s"), "source_size", "target", "passes", cut.alias("cut"))


def _copies() -> Column:
    return F.col("passes") + (F.col("hash") <= F.col("cut")).cast("long")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken per input row."""
    sizes = materialize(sized(docs))
    cuts = thresholds(sizes, source_targets(sizes))
    joined = sizes.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left")
    return joined.select("doc_id", "source", "size", "source_size", "target", _copies().alias("copies"), (_copies() * F.col("size")).alias("taken"))


def take(docs: DataFrame) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken."""
    sizes = materialize(sized(docs))
    cuts = materialize(thresholds(sizes, source_targets(sizes)))
    row = docs.select(whole_row(docs), F.col("source").cast("string").alias("source"), hash_of("doc_id").alias("hash"))
    joined = row.join(cuts, F.col("source").eqNullSafe(F.col("s")))
    return joined.where(_copies() > 0).select("row", F.explode(F.sequence(F.lit(1).cast("long"), _copies()))).select("row.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS hash
  FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), ranked AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM per
), filled AS (
  SELECT *, row_number() OVER o AS k,
         (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0))::DOUBLE
           / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
  FROM ranked
  WINDOW o AS (ORDER BY (3 * source_size)::DOUBLE / weight, source NULLS LAST),
         b AS (ORDER BY (3 * source_size)::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT min(k) AS k0, arg_min(level, k) AS level0 FROM filled WHERE level * weight <= 3 * source_size
), targets AS (
  SELECT source, source_size, CASE WHEN k0 IS NULL OR k < k0 THEN (3 * source_size)::DOUBLE ELSE level0 * weight END AS target FROM filled, f
), rest AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS passes FROM targets
), run AS (
  SELECT d.*, r.source_size, r.target, r.passes, r.target - r.passes * r.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.hash) AS through,
         sum(d.size) OVER (PARTITION BY d.source, d.hash) AS own
  FROM d JOIN rest r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target,
       (size * (passes + CASE WHEN through < rest OR through - own < rest AND abs(through - rest) < abs(through - own - rest) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM run
"""
