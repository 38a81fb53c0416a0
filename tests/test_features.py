"""Documented transactions and edge rows of the feature projection."""

import json

import pytest

from nearvote.config import Config, Normalization, load_config
from nearvote.functions import features as fx
from nearvote.sources.records import parse_requests


def request(**changes):
    body = {
        "id": "x",
        "transaction": {"amount": 41.12, "installments": 2, "requested_at": "2026-03-11T18:45:53Z"},
        "customer": {"avg_amount": 82.24, "tx_count_24h": 3, "known_merchants": ["MERC-003", "MERC-016"]},
        "merchant": {"id": "MERC-016", "mcc": "5411", "avg_amount": 60.25},
        "terminal": {"is_online": False, "card_present": True, "km_from_home": 29.23},
        "last_transaction": None,
    }
    for path, value in changes.items():
        part, _, name = path.partition("__")
        if name:
            body[part][name] = value
        else:
            body[part] = value
    return json.dumps(body)


def vector(spark, body, **options):
    df = parse_requests(spark.createDataFrame([(body,)], "body string"))
    return [round(x, 6) for x in fx.vector(df, **options).first()["vector"]]


def close(got, wanted):
    assert len(got) == len(wanted) and all(abs(a - b) < 1e-4 for a, b in zip(got, wanted, strict=True)), (got, wanted)


# Documented transactions: fixed values that results depend on.
FRAUD = dict(
    transaction={"amount": 9505.97, "installments": 10, "requested_at": "2026-03-14T05:15:12Z"},
    customer={"avg_amount": 81.28, "tx_count_24h": 20, "known_merchants": ["MERC-008", "MERC-007", "MERC-005"]},
    merchant={"id": "MERC-068", "mcc": "7802", "avg_amount": 54.86},
    terminal={"is_online": False, "card_present": True, "km_from_home": 952.27},
)
RECENT = dict(
    transaction={"amount": 120.0, "installments": 1, "requested_at": "2026-03-11T20:23:35Z"},
    customer={"avg_amount": 60.0, "tx_count_24h": 2, "known_merchants": []},
    merchant={"id": "MERC-002", "mcc": "9999", "avg_amount": 300.0},
    terminal={"is_online": True, "card_present": False, "km_from_home": 13.7},
    last_transaction={"timestamp": "2026-03-11T14:58:35Z", "km_from_current": 18.8626479774},
)


def test_legit(spark):
    close(vector(spark, request()), [0.004112, 2 / 12, 0.05, 18 / 23, 2 / 6, -1, -1, 0.02923, 3 / 20, 0, 1, 0, 0.15, 0.006025])


def test_fraud(spark):
    close(vector(spark, request(**FRAUD)), [0.950597, 10 / 12, 1, 5 / 23, 5 / 6, -1, -1, 0.95227, 1, 0, 1, 1, 0.75, 0.005486])


def test_last_transaction_and_unknown_mcc(spark):
    got = vector(spark, request(**RECENT))
    close([got[i] for i in (0, 2, 5, 6, 9, 10, 11, 12)], [0.012, 0.2, 325 / 1440, 0.0188626, 1, 0, 1, 0.5])


def test_exact_minutes_keep_seconds(spark):
    later = dict(RECENT, last_transaction={"timestamp": "2026-03-11T14:58:05Z", "km_from_current": 1.0})
    close([vector(spark, request(**later), exact=True)[5]], [325.5 / 1440])
    close([vector(spark, request(**later))[5]], [325 / 1440])


@pytest.mark.parametrize("average", [0.0, -5.0])
def test_average_not_positive(spark, average):
    assert vector(spark, request(customer__avg_amount=average))[2] == 1.0


def test_negative_gap_is_zero(spark):
    assert vector(spark, request(last_transaction={"timestamp": "2027-01-01T00:00:00Z", "km_from_current": 5.0}))[5] == 0.0


def test_prefix_of_a_known_merchant_is_unknown(spark):
    assert vector(spark, request(merchant__id="MERC-01"))[11] == 1.0


def test_quantize_rounds_half_away_and_saturates(spark):
    df = spark.createDataFrame([(0.00005,), (-0.00005,), (9.0,), (-9.0,)], "x double")
    assert [r[0] for r in df.select(fx.quantize(df.x)).collect()] == [1, -1, 32767, -32768]


def test_bad_requests_are_marked(spark):
    bodies = [request(), "{", "", request(transaction__requested_at="soon"), request(merchant={"id": "a"}), request(last_transaction={"timestamp": "x"}), None]
    df = parse_requests(spark.createDataFrame(list(enumerate(bodies)), "n int, body string"))
    marked = {r.n: r.bad for r in df.select("n", fx.bad_request().alias("bad")).collect()}
    assert marked == {0: False, 1: True, 2: True, 3: True, 4: True, 5: True, 6: True}


def test_config_files(tmp_path, monkeypatch):
    (tmp_path / "n.json").write_text(json.dumps(dict(max_amount=1, max_installments=2, amount_vs_avg_ratio=3, max_minutes=4, max_km=5, max_tx_count_24h=6, max_merchant_avg_amount=7)))
    (tmp_path / "m.json").write_text('{"1": 0.5}')
    monkeypatch.setenv("NORMALIZATION_PATH", str(tmp_path / "n.json"))
    assert load_config(mcc_risk_path=str(tmp_path / "m.json")) == Config(Normalization(1, 2, 3, 4, 5, 6, 7), {"1": 0.5})
    monkeypatch.delenv("NORMALIZATION_PATH")
    assert load_config() == Config()
