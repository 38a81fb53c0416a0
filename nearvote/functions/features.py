"""From a transaction request to 14 features, as one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearvote.config import DEFAULT_RISK, DIMS, SCALE, Config

Q = [f"q{d}" for d in range(DIMS)]


def real(value: Column | float) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("float")


def clamp(value: Column) -> Column:
    return F.greatest(real(0.0), F.least(real(1.0), value))


def ratio(a: Column, b: Column | float) -> Column:
    """32-bit division: Spark divides as double, so the result is rounded back."""
    return (real(a) / real(b)).cast("float")


def quantize(value: Column) -> Column:
    """Scaled, rounded half away from zero, saturated to 16 bits."""
    scaled = F.round(value.cast("float") * real(float(SCALE)))
    return F.greatest(F.lit(-32768.0), F.least(F.lit(32767.0), scaled)).cast("int")


def quantize_array(values: Column) -> Column:
    return F.transform(values, quantize)


def written_time(stamp: Column) -> Column:
    """Minute of an RFC 3339 stamp as written, whatever its offset; null if malformed."""
    return F.try_to_timestamp(F.substring(stamp, 1, 16), F.lit("yyyy-MM-dd'T'HH:mm"))


def instant(stamp: Column) -> Column:
    return F.try_to_timestamp(stamp)


def minutes_between(later: Column, earlier: Column, exact: bool = False) -> Column:
    """Whole minutes by default; with ``exact``, seconds / 60 of the instants, at least 0."""
    if exact:
        return ratio(F.greatest(F.unix_seconds(instant(later)) - F.unix_seconds(instant(earlier)), F.lit(0)), 60.0)
    return F.floor(F.unix_seconds(written_time(later)) / 60) - F.floor(F.unix_seconds(written_time(earlier)) / 60)


def hour(stamp: Column) -> Column:
    return F.hour(written_time(stamp))


def weekday(stamp: Column) -> Column:
    """Monday is 0."""
    return F.weekday(written_time(stamp))


def epoch_day(stamp: Column) -> Column:
    return F.unix_date(written_time(stamp).cast("date"))


def is_unknown(known: Column, merchant: Column) -> Column:
    """A lambda keeps the projection of the features out of whole-stage code: its one
    method would have over 8,000 bytes of byte code, which the JVM never compiles."""
    return (~F.coalesce(F.exists(known, lambda m: m == merchant), F.lit(False))).cast("int")


def risk(mcc: Column, table: dict[str, float]) -> Column:
    pairs = F.create_map(*(x for k, v in sorted(table.items()) for x in (F.lit(k), real(v)))) if table else None
    found = F.try_element_at(pairs, mcc) if table else F.lit(None).cast("float")
    return F.coalesce(found, real(DEFAULT_RISK))


def features(config: Config = Config(), exact: bool = False) -> list[Column]:
    """The 14 features of a row of the request schema, in order."""
    n, c = config.normalization, F.col
    amount, average = real(c("transaction.amount")), real(c("customer.avg_amount"))
    at, last = c("transaction.requested_at"), c("last_transaction")
    seen = last.isNotNull()
    return [
        clamp(ratio(amount, n.max_amount)),
        clamp(ratio(c("transaction.installments"), n.max_installments)),
        clamp(F.when(average <= 0, real(1.0)).otherwise(ratio(ratio(amount, average), n.amount_vs_avg_ratio))),
        ratio(hour(at), 23.0),
        ratio(weekday(at), 6.0),
        F.when(seen, clamp(ratio(minutes_between(at, last["timestamp"], exact), n.max_minutes))).otherwise(real(-1.0)),
        F.when(seen, clamp(ratio(last["km_from_current"], n.max_km))).otherwise(real(-1.0)),
        clamp(ratio(c("terminal.km_from_home"), n.max_km)),
        clamp(ratio(c("customer.tx_count_24h"), n.max_tx_count_24h)),
        real(c("terminal.is_online")),
        real(c("terminal.card_present")),
        real(is_unknown(c("customer.known_merchants"), c("merchant.id"))),
        risk(c("merchant.mcc"), config.mcc_risk),
        clamp(ratio(c("merchant.avg_amount"), n.max_merchant_avg_amount)),
    ]


def vectorize(requests: DataFrame, config: Config = Config(), exact: bool = False, keep: tuple[str, ...] = ("pos", "label")) -> DataFrame:
    """``keep`` and the quantised features q0..q13."""
    return requests.select(*keep, *(quantize(f).alias(q) for q, f in zip(Q, features(config, exact), strict=True)))


def vector(requests: DataFrame, config: Config = Config(), exact: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` and the features as one array of floats."""
    return requests.select(*keep, F.array(*features(config, exact)).alias("vector"))


def decision(votes: Column) -> tuple[Column, Column]:
    """(fraud_score, approved) of a number of fraud votes."""
    from nearvote.config import DENY_VOTES, K

    return (votes / F.lit(float(K))).cast("double"), votes < DENY_VOTES


def bad_request() -> Column:
    """Whether a parsed request lacks something that scoring needs."""
    c = F.col
    needed = ["transaction.amount", "transaction.installments", "customer.avg_amount", "customer.tx_count_24h", "customer.known_merchants", "merchant.id", "merchant.mcc", "merchant.avg_amount", "terminal.is_online", "terminal.card_present", "terminal.km_from_home"]
    bad = written_time(c("transaction.requested_at")).isNull()
    for name in needed:
        bad = bad | c(name).isNull()
    last = c("last_transaction")
    return bad | (last.isNotNull() & (written_time(last["timestamp"]).isNull() | last["km_from_current"].isNull()))
