"""Shared pieces of the corpus operators: word rule, tables on shared storage."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearvote.sources.shared import shared_dir

#: White space and words, as Java, Python and RE2 regular expressions alike.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def gives_back(function: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """A task's function whose worker returns freed memory to the machine when
    the task ends, since workers live on and serve the stages that follow."""

    @wraps(function)
    def run(batches: Iterator[pa.RecordBatch], *rest) -> Iterator[pa.RecordBatch]:
        yield from function(batches, *rest)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return run


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage so that a lost executor costs no more than the tasks that it
    ran; the table goes when the driver's JVM ends, or by :func:`discard`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/nearvote/{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, target = _hadoop(spark, path)
    fs.deleteOnExit(target)
    back = spark.read.schema(df.schema).parquet(path)
    back._nearvote_path = path
    return back


def settle(df: DataFrame) -> DataFrame:
    """Materialize a result, then delete the tables that it was made from
    (those that the operator has listed as its ``_nearvote_parts``)."""
    parts = getattr(df, "_nearvote_parts", ())
    done = materialize(df)
    for part in parts:
        discard(part)
    return done


def discard(df: DataFrame) -> None:
    """Delete a table of :func:`materialize` that no later plan reads."""
    path = getattr(df, "_nearvote_path", None)
    if path:
        fs, target = _hadoop(df.sparkSession, path)
        fs.delete(target, True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct ``row``, so that none clashes with a plan's own."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Ids that a join broadcasts at most (a few MB); beyond it both sides shuffle.
BROADCAST_IDS = 500_000


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` less the rows whose doc_id (null too) is in ``ids``."""
    made = ids.select(F.col("doc_id").cast("long").alias("gone")).distinct()
    made._nearvote_parts = getattr(ids, "_nearvote_parts", ())
    gone = settle(made)
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, F.col("doc_id").cast("long").eqNullSafe(F.col("gone")), "left_anti")


def most_frequent(counted: DataFrame, limit: int) -> DataFrame:
    """Rows of ``counted`` with the greatest ``n``, at most ``limit``.

    The rows above a threshold of n, found from a histogram of log2(n) in steps
    of 1/32 (some 2,000 rows at most reach the driver), so no task and not the
    driver ever holds more than ``limit`` rows.
    """
    step = F.floor(F.log2("n") * 32).cast("int")
    histogram = sorted(((r["step"], r["c"]) for r in counted.groupBy(step.alias("step")).agg(F.count("*").alias("c")).collect()), reverse=True)
    total, least = 0, None
    for at, c in histogram:
        total += c
        if total > limit:
            break
        least = at
    return counted.where(step >= least) if least is not None else counted.where(F.lit(False))
