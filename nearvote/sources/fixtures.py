"""Requests derived from the ``events`` table by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Merchant categories by turns; the last two have no risk of their own.
MCCS = ("5411", "5812", "5912", "5944", "7801", "7802", "7995", "4511", "5311", "5999", "0000", "9999")
#: Searches take every row whose id is divisible by this as a query, against all rows.
QUERY_EVERY = 100


def merchant(number):
    return F.format_string("MERC-%03d", number)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, label and the request schema, one row per event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    c = F.col
    stamp = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    last = F.lag("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    number = lambda x: x.cast("double")
    return e.withColumn("last_ts", last).select(
        c("event_id").alias("pos"),
        (c("event_type") == "error").cast("int").alias("label"),
        c("event_id").cast("string").alias("id"),
        F.struct((c("value") * 20).alias("amount"), (c("event_id") % 12 + 1).cast("int").alias("installments"), stamp("ts").alias("requested_at")).alias("transaction"),
        F.struct(
            number(((c("user_id") * 37) % 400 + 1) * 5).alias("avg_amount"),
            ((c("event_id") * 7) % 25).cast("int").alias("tx_count_24h"),
            F.array(merchant(c("user_id") % 50), merchant((c("user_id") + 7) % 50)).alias("known_merchants"),
        ).alias("customer"),
        F.struct(
            merchant(c("event_id") % 50).alias("id"),
            F.get(F.array(*map(F.lit, MCCS)), (c("event_id") % 12).cast("int")).alias("mcc"),
            number(((c("event_id") * 53) % 2000) * 6).alias("avg_amount"),
        ).alias("merchant"),
        F.struct((c("event_id") % 2 == 1).alias("is_online"), (c("event_id") % 3 == 0).alias("card_present"), number((c("event_id") * 31) % 1200).alias("km_from_home")).alias("terminal"),
        F.when(c("last_ts").isNotNull(), F.struct(stamp("last_ts").alias("timestamp"), number((c("event_id") * 17) % 1100).alias("km_from_current"))).alias("last_transaction"),
    )


def is_query():
    return F.col("pos") % QUERY_EVERY == 0
