"""Nearest-neighbour mutual information against all pairs, the curve's rolls, and stateful stream steps."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import neighbours as N
from tidemark.plans import catalogue, curve
from tidemark.streaming import streams


def psi(n):
    return -0.5772156649015329 + sum(1 / j for j in range(1, n))


def brute_mi(x, y, k):
    n = len(x)
    if n <= k:
        return 0.0
    gx, gy = abs(x[:, None] - x[None]), abs(y[:, None] - y[None])
    both = np.maximum(gx, gy)
    r = np.sort(both, axis=1)[:, k]
    nx, ny = np.maximum(1, (gx < r[:, None]).sum(1)), np.maximum(1, (gy < r[:, None]).sum(1))
    return max(0.0, psi(n) + psi(k) - np.mean([psi(int(v)) for v in nx]) - np.mean([psi(int(v)) for v in ny]))


@pytest.mark.parametrize("reach", [2, 48])
def test_mutual_information_matches_all_pairs(spark, monkeypatch, reach):
    """With windows that are too short at first, ties, constants, clusters and groups smaller than k."""
    rng = np.random.default_rng(1)
    u = rng.normal(size=150)
    groups = {"linear": (u, u + 0.1 * rng.normal(size=150)), "none": (u, rng.normal(size=150)), "ties": (np.round(u), np.round(u * 2)), "flat": (u * 0, u), "square": (u, u * u), "three": (u[:3], u[:3]), "five": (u[:5], u[5:10])}
    ints = {g: (np.round(x * 1e6).astype(int), np.round(y * 1e6).astype(int)) for g, (x, y) in groups.items()}
    rows = [(g, k, int(a), int(b)) for g, (x, y) in ints.items() for k, (a, b) in enumerate(zip(x, y, strict=True))]
    plain = N.kth_distances
    monkeypatch.setattr(N, "kth_distances", lambda points, by, k: plain(points, by, k, reach))
    got = {r.g: r.mi for r in N.mutual_information(spark.createDataFrame(rows, "g string, id long, x long, y long"), ["g"]).collect()}
    assert got.keys() == groups.keys()
    for g, (x, y) in ints.items():
        assert got[g] == pytest.approx(brute_mi(x, y, 3), abs=1e-8), g
    assert got["linear"] > 1 and got["square"] > 0.5 and got["none"] < 0.2


def test_digamma(spark):
    got = [r.p for r in spark.range(1, 60).orderBy("id").select(N.digamma(F.col("id").cast("double")).alias("p")).collect()]
    assert got == pytest.approx([psi(n) for n in range(1, 60)], abs=2e-9)


def test_rolls_shift_all_earlier_days(spark, sf_dir):
    rows = curve.curve(spark, sf_dir).where("series_id = 'A'").orderBy("d").collect()
    assert sum(bool(r.rolled) for r in rows) > 50
    assert rows[-1].adjusted == pytest.approx(rows[-1].c1)
    for a, b in zip(rows, rows[1:], strict=False):
        own = b.c1 - (a.c2 if b.rolled else a.c1)  # what holding the contract from one day to the next earns
        assert b.adjusted - a.adjusted == pytest.approx(own, abs=1e-6)
        assert a.front < a.next and a.front > a.d


HOUR = 3600 * 1000


def test_calls_wait_for_168_hours_and_skip_rolls():
    call = lambda at, i, side, contract=1, price=80.0: (at, i, "view", price, contract, side)
    quote = lambda at, i, price, contract=1: (at, i, "quote", price, contract, "")
    past, out, _ = streams._resolve((7,), None, [call(0, 1, "LONG"), call(0, 2, "SHORT"), call(HOUR, 3, "LONG", 2), quote(168 * HOUR - 1, 4, 99.0)], 0)
    assert not out and len(past) == 3
    past, out, _ = streams._resolve((7,), past, [quote(168 * HOUR, 5, 82.0)], 0)
    assert [(r[1], r[5], r[6], r[7], r[8]) for r in out] == [(1, 82.0, False, 2.5, True), (2, 82.0, False, 2.5, False)] and len(past) == 1
    past, out, _ = streams._resolve((7,), past, [quote(169 * HOUR, 6, 70.0)], 0)
    assert [(r[1], r[6], r[7], r[8]) for r in out] == [(3, True, None, None)] and not past
    _, out, _ = streams._resolve((7,), None, [call(0, 1, "SHORT"), call(0, 2, "NEUTRAL"), quote(200 * HOUR, 3, 80.0)], 0)
    assert [r[8] for r in out] == [True, None]


def test_a_silent_feed_goes_stale_and_expires():
    minute = 60 * 1000
    state, out, wake = streams._feed((7,), None, [(0, 1), (25 * minute, 2)], 25 * minute)
    assert [r[1:] for r in out] == [("live", 0)] and wake == 50 * minute
    state, out, wake = streams._feed((7,), state, [], 51 * minute)
    assert [r[1:] for r in out] == [("stale", 50 * minute)] and wake == 25 * minute + 3 * HOUR
    state, out, wake = streams._feed((7,), state, [], 25 * minute + 3 * HOUR)
    assert [r[1:] for r in out] == [("expired", 25 * minute + 3 * HOUR)] and wake is None
    _, out, _ = streams._feed((7,), state, [(9 * HOUR, 3)], 9 * HOUR)
    assert [r[1:] for r in out] == [("live", 9 * HOUR)]
    assert math.isclose(streams.FRESH_MS, 25 * minute)


def test_joint_forecasts_do_not_see_later_quotes(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    cut = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    events.withColumn("value", F.when(F.col("ts") >= cut, F.col("value") * 3 + 1).otherwise(F.col("value"))).write.parquet(str(tmp_path / "events.parquet"))
    rows = []
    for d in (sf_dir, str(tmp_path)):
        got = catalogue.QUERIES["joint_horizons"](spark, d).where(F.col("h") < cut - F.expr("INTERVAL 1 HOUR")).drop("actual_1h").collect()
        rows.append({(r.series_id, r.h): r for r in got})
    assert len(rows[0]) > 20 and rows[0] == rows[1]
    assert all(r.daily_as_of is None or r.daily_as_of <= r.h for r in rows[0].values())
