"""Registered queries against their SQL, on whole tables."""

import pytest

from nearvote.plans.registry import ORACLES, QUERIES
from tests.conftest import SF, rows_of, rows_of_sql


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got, wanted = rows_of(QUERIES[name](spark, SF)), rows_of_sql(duck, ORACLES[name])
    assert got[0] == wanted[0]
    assert got[1] == wanted[1]


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"f16_bits"}


def test_features_are_compiled(spark):
    """The JVM compiles no method of more than 8,000 bytes of byte code, and runs it many times slower."""
    df = QUERIES["vectorize_tx"](spark, SF)
    df.collect()
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    stages = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan())
    assert stages.length() and all(stages.apply(i)._3().maxMethodCodeSize() <= 8_000 for i in range(stages.length()))


@pytest.mark.parametrize("name", ["fraud_decision", "knn_exact_top5"])
def test_exact_searches_read_written_vectors(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "events.parquet" not in plan and "last_ts" not in plan


@pytest.mark.parametrize("name", ["fraud_decision", "knn_exact_top5"])
def test_exact_search_in_blocks_equals_its_sql(spark, duck, name, monkeypatch):
    from nearvote.operators import boxes, knn

    searched = []
    plain = boxes.nearest
    monkeypatch.setattr(knn, "SCAN_QUERIES", 10)
    monkeypatch.setattr(boxes, "nearest", lambda *a: searched.append(name) or plain(*a))
    assert rows_of(QUERIES[name](spark, SF)) == rows_of_sql(duck, ORACLES[name])
    assert searched


def test_half_precision_bits(spark):
    import numpy as np
    import pyarrow.parquet as pq

    rows = QUERIES["f16_bits"](spark, SF).where("vec_id < 20").collect()
    source = {r["vec_id"]: r["embedding"] for r in pq.read_table(f"{SF}/embeddings.parquet").to_pylist()}
    assert rows and all(np.float16(np.float32(source[r.vec_id][r.dim])).view(np.int16) == r.bits for r in rows)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["qid", "votes", "fraud_score", "approved"] and df.count() > 0
