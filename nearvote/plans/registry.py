"""Named queries of the library and their DuckDB equivalents.

All run on requests derived from ``events``. Every row is a labelled reference;
those whose id is divisible by 100 are the queries of the searches, against all
rows. ``NLIST`` is small, as the tables are.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearvote.config import SCALE
from nearvote.functions import features as fx
from nearvote.functions.features import Q
from nearvote.operators import evaluate, ivf, knn, layout
from nearvote.plans import oracles
from nearvote.sources import fixtures, records
from nearvote.sources.shared import shared_dir
from nearvote.streaming import scorer

NLIST, GROUP = oracles.NLIST, oracles.GROUP


def vectors(spark: SparkSession, sf_dir: str, exact: bool = False) -> DataFrame:
    return fx.vectorize(fixtures.requests(spark, sf_dir), exact=exact)


def queries_of(table: DataFrame) -> DataFrame:
    return table.where(fixtures.is_query()).select(F.col("pos").alias("qid"), *Q)


def index_layout(table: DataFrame) -> DataFrame:
    return layout.lay_out(table.withColumnRenamed("pos", "row_id"))


def held(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(queries, layout), the layout cached for the scans of a build."""
    table = vectors(spark, sf_dir)
    return queries_of(table), index_layout(table).cache()


def vectorize_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir)


def vectorize_tx_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir, exact=True).select("pos", "q5")


def time_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("transaction.requested_at")
    return fixtures.requests(spark, sf_dir).select(F.col("pos").alias("event_id"), fx.hour(at).alias("hour"), fx.weekday(at).alias("weekday"), fx.epoch_day(at).alias("epoch_day"))


def minutes_since_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = fx.minutes_between(F.col("transaction.requested_at"), F.col("last_transaction.timestamp"))
    return fixtures.requests(spark, sf_dir).select(F.col("pos").alias("event_id"), gap.cast("long").alias("minutes"))


def unknown_merchant_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = fx.is_unknown(F.col("customer.known_merchants"), F.col("merchant.id"))
    return fixtures.requests(spark, sf_dir).select(F.col("pos").alias("event_id"), flag.alias("flag"))


def mcc_risk_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearvote.config import MCC_RISK

    mcc = F.col("merchant.mcc")
    return fixtures.requests(spark, sf_dir).select(F.col("pos").alias("event_id"), mcc.alias("mcc"), fx.quantize(fx.risk(mcc, MCC_RISK)).alias("risk_q"))


def json_extract_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


def _dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select("vec_id", F.posexplode("embedding").alias("dim", "x"))


def quantize_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select("vec_id", F.posexplode(fx.quantize_array(F.col("embedding"))).alias("dim", "q"))


def f16_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.half_bits(_dims(spark, sf_dir).withColumnRenamed("vec_id", "id")).withColumnRenamed("id", "vec_id")


def partition_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("pos", layout.partition_key().alias("pkey"))


def partition_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.partition_offsets(vectors(spark, sf_dir))


def block_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.block_bounds(index_layout(vectors(spark, sf_dir)))


def block_lower_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, rows = held(spark, sf_dir)
    return knn.block_lower_bounds(queries, layout.block_bounds(rows)).select("qid", "pkey", "block", "lb")


def dataset_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.metadata(vectors(spark, sf_dir)).select("total", "fraud", "legit")


def index_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.ready(vectors(spark, sf_dir))


def _exact(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(queries, their nearest rows); the vectors are written once, as a search reads them several times."""
    at = scratch(spark)
    vectors(spark, sf_dir).write.parquet(at)
    table = spark.read.parquet(at)
    queries = queries_of(table)
    return queries, knn.exact_knn(queries, table)


def knn_exact_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact(spark, sf_dir)[1].select("qid", "rk", "pos", "d")


def knn_embeddings_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("v", fx.quantize_array(F.col("embedding")))
    names = [f"e{d}" for d in range(64)]
    flat = e.select(F.col("vec_id").alias("pos"), F.col("label").cast("int").alias("label"), *(F.col("v")[d].alias(n) for d, n in enumerate(names)))
    queries = flat.where(fixtures.is_query()).select(F.col("pos").alias("qid"), *names)
    return knn.exact_knn(queries, flat, columns=names).select("qid", "rk", "pos", "d")


def fraud_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, hits = _exact(spark, sf_dir)
    fraud_score, approved = fx.decision(F.col("votes"))
    return knn.all_queries(queries, knn.votes(hits)).select("qid", "votes", fraud_score.alias("fraud_score"), approved.alias("approved"))


def knn_partition_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, rows = held(spark, sf_dir)
    return knn.all_queries(queries, knn.votes(knn.partition_knn(queries, rows)))


def knn_block_pruned_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, rows = held(spark, sf_dir)
    return knn.all_queries(queries, knn.votes(knn.block_knn(queries, rows, layout.block_bounds(rows))))


def ivf_seed_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivf.seed_centroids(held(spark, sf_dir)[1], NLIST)


def _cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queries, centroids, rows with their cell)."""
    queries, rows = held(spark, sf_dir)
    used, new = ivf.kmeans(rows, NLIST)
    return queries, ivf.table(spark, new), ivf.assign(rows, used)


def ivf_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = held(spark, sf_dir)[1]
    return ivf.assign(rows, ivf.matrix(ivf.seed_centroids(rows, NLIST))).select("pos", "cell")


def ivf_kmeans_iter(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, centroids, cells = _cells(spark, sf_dir)
    n = ivf.cell_counts(cells)
    return centroids.join(n, "cell", "left").select("cell", F.coalesce("n", F.lit(0)).cast("long").alias("n"), *ivf.C)


def ivf_cell_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivf.cell_offsets(_cells(spark, sf_dir)[2], NLIST)


def ivf_cell_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivf.cell_stats(_cells(spark, sf_dir)[2], NLIST)


def ivf_coarse_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivf.coarse_centroids(_cells(spark, sf_dir)[1], GROUP)


def ivf_probe_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, centroids, _ = _cells(spark, sf_dir)
    return ivf.probe(queries, centroids).select("qid", "probe_rank", "cell", "d")


def ivf_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, centroids, cells = _cells(spark, sf_dir)
    return knn.all_queries(queries, knn.votes(ivf.ivf_knn(queries, centroids, cells))).select("qid", "votes")


def accuracy_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = held(spark, sf_dir)[1]
    used, new = ivf.kmeans(rows, NLIST)
    queries = evaluate.systematic_sample(rows, rows.count())
    exact = knn.all_queries(queries, knn.votes(knn.exact_knn(queries, rows)))
    found = knn.all_queries(queries, knn.votes(ivf.ivf_knn(queries, ivf.table(spark, new), ivf.assign(rows, used))))
    return evaluate.accuracy(exact, found)


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that all executors share."""
    return f"{shared_dir(spark)}/nearvote-{uuid.uuid4().hex}"


def stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests written as JSON lines, read and scored as a stream."""
    _, centroids, cells = _cells(spark, sf_dir)
    at = scratch(spark)
    body = F.to_json(F.struct("id", "transaction", "customer", "merchant", "terminal", "last_transaction"))
    bodies = fixtures.requests(spark, sf_dir).where(fixtures.is_query()).select(F.col("pos").alias("qid"), body.alias("body"))
    bodies.write.json(f"{at}/in")
    stream = spark.readStream.schema("qid long, body string").json(f"{at}/in")
    scorer.start(stream, centroids, cells, f"{at}/out", f"{at}/state", available_now=True).awaitTermination()
    return spark.read.parquet(f"{at}/out").select("qid", "votes")


def stream_bad_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same stream with every seventh body cut short: status 400, and the others go on."""
    _, centroids, cells = _cells(spark, sf_dir)
    at = scratch(spark)
    body = F.to_json(F.struct("id", "transaction", "customer", "merchant", "terminal", "last_transaction"))
    broken = F.when(F.col("pos") % (7 * fixtures.QUERY_EVERY) == 0, F.expr("substr(body, 1, 40)")).otherwise(F.col("body"))
    bodies = fixtures.requests(spark, sf_dir).where(fixtures.is_query()).withColumn("body", body).select(F.col("pos").alias("qid"), broken.alias("body"))
    bodies.write.json(f"{at}/in")
    stream = spark.readStream.schema("qid long, body string").json(f"{at}/in")
    scorer.start(stream, centroids, cells, f"{at}/out", f"{at}/state", available_now=True, spread=4).awaitTermination()
    return spark.read.parquet(f"{at}/out").select("qid", "status", "votes")


def route_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What requests made from events by turns ask for."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    path = F.get(F.array(*map(F.lit, oracles.PATHS)), (F.col("event_id") % len(oracles.PATHS)).cast("int"))
    method = F.when(F.col("user_id") % 2 == 0, "POST").otherwise("GET")
    return e.select("event_id", scorer.route(method, path).alias("asked"))


def reference_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References written as JSON lines and read, checked and quantised again."""
    at = scratch(spark)
    vector = F.array(*((F.col(q) / SCALE).cast("float") for q in Q)).alias("vector")
    vectors(spark, sf_dir).select(vector, records.label_name(F.col("label")).alias("label")).write.json(at, compression="gzip")
    return records.read_references(spark, at, json_lines=True).select("label", *Q)


def index_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an index that was built, written, validated and loaded."""
    at = scratch(spark)
    _, rows = held(spark, sf_dir)
    used, new = ivf.kmeans(rows, NLIST)
    records.save_index(rows, layout.block_bounds(rows), ivf.table(spark, new), ivf.assign(rows, used), at)
    tables = records.load_index(spark, at)
    cells = tables["cells"].select("pos", "cell")
    return tables["vectors"].join(cells, "pos").select("pos", F.col("pkey").cast("int").alias("pkey"), "block", F.col("label").cast("int").alias("label"), "cell", *(F.col(q).cast("int").alias(q) for q in Q))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        vectorize_tx, vectorize_tx_exact, time_features, minutes_since_last, unknown_merchant_flag, mcc_risk_lookup, json_extract_props, quantize_embeddings,
        f16_bits, partition_key, partition_offsets, block_bounds, block_lower_bounds, dataset_meta, index_ready, knn_exact_top5, knn_embeddings_top5,
        fraud_decision, knn_partition_top5, knn_block_pruned_top5, ivf_seed_centroids, ivf_assign, ivf_kmeans_iter, ivf_cell_offsets, ivf_cell_stats,
        ivf_coarse_centroids, ivf_probe_top3, ivf_votes, accuracy_report, stream_score,
        stream_bad_requests, route_requests, reference_scan, index_round_trip,
    )
}
ORACLES: dict[str, str] = oracles.ORACLES
