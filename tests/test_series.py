"""Known answers, leak checks and edges of series functions."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import recursive, stats
from tidemark.functions import series as S
from tidemark.functions.folds import kept_heartbeats
from tidemark.operators.asof import asof_join
from tidemark.plans import evaluation, learning

DAY = dt.date(2026, 1, 1)


def bars(spark, closes, series="a"):
    rows = [(series, DAY + dt.timedelta(days=k), float(c)) for k, c in enumerate(closes)]
    return spark.createDataFrame(rows, "series_id string, d date, close double")


def wilder(xs, n=14):
    if len(xs) < n + 1:
        return 50.0
    m = np.diff(xs)
    g, l = np.maximum(m, 0), np.maximum(-m, 0)  # noqa: E741
    a, b = g[:n].mean(), l[:n].mean()
    for x, y in zip(g[n:], l[n:], strict=True):
        a, b = (a * (n - 1) + x) / n, (b * (n - 1) + y) / n
    return 100.0 if b == 0 else 100 - 100 / (1 + a / b)


def test_rsi_and_macd_match_plain_python(spark):
    closes = [70 + 0.4 * i + 3 * math.sin(i / 5) for i in range(80)]
    got = bars(spark, closes).withColumn("xs", F.collect_list("close").over(S.past(63)))
    got = got.select("d", recursive.rsi(F.col("xs")).alias("rsi"), recursive.macd(F.col("xs")).alias("m")).orderBy("d").collect()
    for k, row in enumerate(got):
        xs = closes[max(0, k - 62) : k + 1]
        assert row.rsi == pytest.approx(wilder(np.array(xs)), abs=1e-9)
        s = pd.Series(xs)
        line = s.ewm(span=12, adjust=False).mean() - s.ewm(span=26, adjust=False).mean()
        assert row.m.fast - row.m.slow == pytest.approx(line.iloc[-1], abs=1e-9)
        assert row.m.signal == pytest.approx(line.ewm(span=9, adjust=False).mean().iloc[-1], abs=1e-9)


def test_rising_series_has_full_strength(spark):
    df = spark.createDataFrame([([float(k) for k in range(20)],), ([],)], "xs array<double>").select(recursive.rsi(F.col("xs")).alias("r"))
    assert [r.r for r in df.collect()] == [100.0, 50.0]


def test_full_window_needs_all_values(spark):
    got = bars(spark, [1, 2, 3, 4]).select("d", S.full(F.col("close"), F.avg("close"), 3).alias("m")).orderBy("d").collect()
    assert [r.m for r in got] == [None, None, 2.0, 3.0]


def test_flat_series_has_no_zscore_and_no_error(spark):
    got = bars(spark, [5] * 25).select(S.rolling_zscore(F.col("close"), 20).alias("a"), S.tail_zscore(F.col("close"), 20).alias("b"), S.skewness_g1(F.col("close"), S.past(20)).alias("c")).collect()
    assert {r.a for r in got} == {None} and {r.b for r in got} == {0.0} and {r.c for r in got} == {0.0}


def test_ratio_guards(spark):
    got = spark.createDataFrame([(1.0, 0.0), (1.0, None), (1.0, 2.0)], "a double, b double").select(S.ratio(F.col("a"), F.col("b"), 7.0).alias("r")).collect()
    assert [r.r for r in got] == [7.0, 7.0, 0.5]


def test_asof_boundary_ties_and_tolerance(spark):
    left = spark.createDataFrame([("a", 10), ("a", 14), ("a", 15), ("b", 1)], "k string, t int")
    right = spark.createDataFrame([("a", 10, 1.0), ("a", 15, 2.0), ("a", None, 9.0)], "k string, u int, v double")
    back = {(r.k, r.t): r.v for r in asof_join(left, right, ["k"], "t", "u", ["v"]).collect()}
    assert back == {("a", 10): 1.0, ("a", 14): 1.0, ("a", 15): 2.0, ("b", 1): None}
    fwd = {(r.k, r.t): r.v for r in asof_join(left, right, ["k"], "t", "u", ["v"], "forward", F.col("u") - F.col("t") <= 0).collect()}
    assert fwd == {("a", 10): 1.0, ("a", 14): None, ("a", 15): 2.0, ("b", 1): None}


def test_binomial_and_normal_tails(spark):
    df = spark.createDataFrame([(0.0, 5.0, 0.5), (5.0, 5.0, 0.5), (3.0, 5.0, 0.5), (None, 5.0, 0.5)], "k double, n double, p double")
    got = [r.t for r in df.select(stats.binomial_tail("k", "n", "p").alias("t")).collect()]
    assert got[:3] == pytest.approx([1.0, 1 / 32, 0.5]) and got[3] is None
    z = spark.createDataFrame([(0.0,), (1.96,)], "z double").select(stats.normal_tail("z").alias("t")).collect()
    assert [r.t for r in z] == pytest.approx([0.5, 0.0249979], abs=1e-6)


def test_heartbeats():
    t = pd.Timestamp("2026-01-05")
    hours, n = [0, 1, 13, 14, 15], 5
    rows = pd.DataFrame({"user_id": [1] * n, "event_id": range(n), "ts": [t + pd.Timedelta(f"{h}h") for h in hours], "price": [1.0, 1.0, 1.0, 2.0, 2.0], "volume": [0] * n, "session_open": [True] * 4 + [False], "run": [1, 1, 1, 2, 2]})
    rows = pd.concat([rows, rows.assign(user_id=2), rows.assign(user_id=2, run=rows.run + 2, event_id=rows.event_id + n)])
    for size in (1, 2, 3, 10):  # the same whatever the batches
        got = pd.concat(kept_heartbeats(rows[k : k + size] for k in range(0, 3 * n, size)))
        assert list(zip(got.user_id, got.event_id)) == [(u, k + more) for u, more in ((1, 0), (2, 0), (2, n)) for k in (0, 2, 4)]


def _with_jump(spark, sf_dir, tmp_path):
    """The same tables with one price late in the series changed."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    late = orders.agg(F.percentile_approx(F.unix_date(F.col("o_orderdate").cast("date")), 0.8)).first()[0]
    jumped = orders.withColumn("o_totalprice", F.when(F.unix_date(F.col("o_orderdate").cast("date")) > late, F.col("o_totalprice") * 3).otherwise(F.col("o_totalprice")))
    jumped.write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path), dt.date(1970, 1, 1) + dt.timedelta(days=late)


def test_features_do_not_see_later_prices(spark, sf_dir, tmp_path):
    other, last = _with_jump(spark, sf_dir, tmp_path)
    keep = ["series_id", "d", *learning.FEATURES]
    a, b = (learning.matrix(spark, d).where(F.col("d") <= F.lit(last)).select(*keep).orderBy("series_id", "d").collect() for d in (sf_dir, other))
    assert a == b and a


def test_walk_forward_fits_do_not_see_later_prices(spark, tmp_path):
    source = "/root/testdata/sf0.01"
    other, last = _with_jump(spark, source, tmp_path)
    a, b = (evaluation.har_fits(spark, d).where(F.col("d") <= F.lit(last)).select("series_id", "d", "predicted", "n_train").orderBy("series_id", "d").collect() for d in (source, other))
    assert a == b and a


def test_purged_frame_ends_where_the_last_label_is_known(spark):
    source = "/root/testdata/sf0.01"
    rows = evaluation.har_rows(spark, source).select("series_id", "d", "i")
    fits = evaluation.har_fits(spark, source).join(rows, ["series_id", "d"])
    assert fits.where(F.col("n_train") != F.col("i") - evaluation.STEPS).count() == 0
