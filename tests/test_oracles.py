"""Every query with an oracle gives the oracle's rows."""

from __future__ import annotations

import pytest

from tests.oracle import oracle_rows, spark_rows
from tidemark.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_its_oracle(spark, sf_dir, name):
    got = spark_rows(catalogue.QUERIES[name](spark, sf_dir))
    assert got == oracle_rows(catalogue.ORACLES[name], sf_dir)


@pytest.mark.parametrize("name", ["horizon_accuracy_rollup", "quality_classification", "nearest_price_24h", "event_window_response", "feature_relevance", "best_baseline"])
def test_divisions_at_a_size_with_zero_prices(spark, name):
    larger = "/root/testdata/sf0.1"
    assert spark_rows(catalogue.QUERIES[name](spark, larger)) == oracle_rows(catalogue.ORACLES[name], larger)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_oracle_runs(spark, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    assert df.columns and df.count() >= 0


def test_payload_of_a_hot_user_is_aligned(spark, tmp_path):
    events = spark.range(100_010).selectExpr("id AS event_id", "IF(id < 5, 17L, 1L) AS user_id", "timestamp_seconds(id) AS ts", "1.0D + id % 7 AS value")
    events.write.parquet(str(tmp_path / "events.parquet"))
    got = {r.user_id: r.violations for r in catalogue.QUERIES["payload_validation"](spark, str(tmp_path)).collect()}
    assert "aligned" not in got[1] and "aligned" in got[17]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
