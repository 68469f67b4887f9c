"""Fits at each decision row against fits of the rows known by then, one by one."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.plans import catalogue, display, refits
from tidemark.plans.evaluation import EVERY, MIN_TRAIN, STEPS
from tidemark.plans.learning import FEATURES, matrix


def test_ridge_is_fitted_on_rows_known_by_then(spark, sf_dir):
    rows = matrix(spark, sf_dir).where("series_id = '1-URGENT'").orderBy("d").toPandas()
    got = catalogue.QUERIES["walkforward_ridge"](spark, sf_dir).where("series_id = '1-URGENT'").orderBy("d").toPandas()
    x, y = np.column_stack([np.ones(len(rows)), rows[list(FEATURES)]]), rows.target.to_numpy()
    places = [k for k in range(len(rows)) if k + 1 > MIN_TRAIN and k % EVERY == 0]
    assert len(places) == len(got) > 10
    for k, (_, r) in zip(places, got.iterrows(), strict=True):
        for name, first in (("expanding", 0), ("rolling", max(0, k - STEPS + 1 - refits.ROLLING))):
            own = slice(first, k - STEPS + 1)
            a = x[own].T @ x[own] + 1e-4 * len(x[own]) * np.diag([0, *[1] * len(FEATURES)])
            assert r[f"{name}_forecast"] == pytest.approx(float(np.linalg.solve(a, x[own].T @ y[own]) @ x[k]), abs=2e-6)


def test_later_prices_do_not_reach_earlier_refits(spark, sf_dir, tmp_path):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    cut = orders.agg(F.percentile_approx(F.unix_seconds(F.col("o_orderdate").cast("timestamp")), 0.7)).first()[0]
    late = F.unix_seconds(F.col("o_orderdate").cast("timestamp")) > cut
    orders.withColumn("o_totalprice", F.when(late, F.col("o_totalprice") * 3).otherwise(F.col("o_totalprice"))).write.parquet(str(tmp_path / "orders.parquet"))
    for name in ("walkforward_refit", "walkforward_ridge"):
        a, b = ({(r.series_id, str(r.d), r.asDict().get("training")): [v for k, v in r.asDict().items() if k.endswith("forecast")] for r in catalogue.QUERIES[name](spark, d).where(F.unix_seconds(F.col("d").cast("timestamp")) <= cut).collect()} for d in (sf_dir, str(tmp_path)))
        assert a and all(a[k] == b[k] for k in set(a) & set(b))


def test_implied_volatility_enters_the_fit_and_bad_rows_leave(spark, sf_dir):
    rows = refits.implied_rows(spark, sf_dir).where("series_id = '1-URGENT'").orderBy("d").toPandas()
    assert (rows.implied > 0).all()
    got = catalogue.QUERIES["har_iv_multiregressor"](spark, sf_dir).where("series_id = '1-URGENT'").orderBy("d").toPandas()
    x = np.column_stack([np.ones(len(rows)), *(np.log(rows[c]) for c in ("rv5", "rv22", "rv66", "implied"))])
    y = np.log(rows.target.to_numpy(dtype=float))
    places = [k for k in range(len(rows)) if k + 1 > MIN_TRAIN and k % EVERY == 0 and np.isfinite(y[k])]
    assert len(places) == len(got) > 5
    for k, (_, r) in zip(places, got.iterrows(), strict=True):
        known = slice(0, k - STEPS + 1)
        assert r.predicted == pytest.approx(float(np.exp(np.linalg.lstsq(x[known], y[known], rcond=None)[0] @ x[k])), rel=1e-4)


def test_target_encodings_and_their_inverse(spark):
    row = spark.createDataFrame([(100.0, 103.5, 0.01), (0.0, 5.0, 0.0), (100.0, None, None)], "r double, t double, b double").select(
        display.encoded(F.col("r"), F.col("t")).alias("plain"), display.encoded(F.col("r"), F.col("t"), F.col("b")).alias("excess"), display.decoded(F.col("r"), F.lit(0.025), F.lit(0.01)).alias("back")
    ).collect()
    assert row[0].plain == pytest.approx(0.035) and row[0].excess == pytest.approx(0.025) and row[0].back == pytest.approx(103.5)
    assert row[1].plain == 0 and row[1].back == 0 and row[2].plain == 0
