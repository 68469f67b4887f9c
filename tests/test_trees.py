"""Trees over DataFrames against trees grown row by row in Python, and the walk-forward's training sets."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import linear as L
from tidemark.functions import series as S
from tidemark.operators import trees as T
from tidemark.plans import catalogue, evaluation, forests, learning, rules

BY = ["tree"]


def plain_split(rows, features, least, only=None):
    """``(feature, bin)`` by trying every cut; rows are ``(x, y, w)``."""
    best = None
    for f in features:
        for b in sorted({x[f] for x, _, _ in rows}):
            if only is not None and b != max((x[f] for x, _, _ in rows if x[f] <= only(f)), default=None):
                continue
            sides = [[(y, w) for x, y, w in rows if (x[f] <= b) == left] for left in (True, False)]
            n = [sum(w for _, w in s) for s in sides]
            if min(n) < least:
                continue
            gain = sum(float(sum(w * y for y, w in s)) * float(sum(w * y for y, w in s)) / float(k) for s, k in zip(sides, n, strict=True))
            if best is None or gain > best[0]:
                best = gain, f, b
    return best and best[1:]


def plain_leaf(train, x, depth, least, features, node=1, only=None):
    """The rows of the leaf that ``x`` falls in."""
    cut = plain_split(train, features, least, only and (lambda f: only(node, f))) if depth else None
    if cut is None:
        return train
    f, b = cut
    right = x[f] > b
    return plain_leaf([r for r in train if (r[0][f] > b) == right], x, depth - 1, least, features, 2 * node + right, only)


def mean(rows):
    return float(sum(w * y for _, y, w in rows)) / float(sum(w for *_, w in rows))


def examples(seed, n=60, features=3):
    rng = random.Random(seed)
    return [([rng.randrange(5) for _ in range(features)], rng.randrange(-1000, 1000), rng.choice([1, 1, 2, 3])) for _ in range(n)]


def frame(spark, sets, asked):
    rows = [(t, k, x, y, w) for t, train in sets.items() for k, (x, y, w) in enumerate(train)]
    rows += [(t, 1000 + k, x, 10**9, 0) for t in sets for k, x in enumerate(asked)]
    return spark.createDataFrame(rows, "tree long, i long, x array<int>, y long, w long")


def test_trees_match_plain_ones(spark):
    sets, asked = {1: examples(1), 2: examples(2, 200), 3: [([1, 1, 1], 5, 1)] * 20, 4: examples(4, 8)}, [[a, b, c] for a in range(0, 5, 2) for b in range(5) for c in (0, 3)]
    got = T.with_leaf_means(T.grown(frame(spark, sets, asked), BY, 3, 5), BY).where("w = 0").collect()
    assert len(got) == len(sets) * len(asked)
    for r in got:
        assert r["mean"] == mean(plain_leaf(sets[r.tree], asked[r.i - 1000], 3, 5, range(3)))


def test_random_cuts_and_masks(spark):
    sets, asked = {1: examples(5, 100), 2: examples(6, 100)}, [[a, b, 2] for a in range(5) for b in range(5)]
    only = lambda node, f: (node * 3 + f * 5) % 4
    rows = frame(spark, sets, asked).withColumn("chosen", F.array(F.lit(0), F.lit(2)))
    got = T.with_leaf_means(T.grown(rows, BY, 3, 5, (F.col("node") * 3 + F.col("feature") * 5) % 4, "chosen"), BY).where("w = 0").collect()
    for r in got:
        assert r["mean"] == mean(plain_leaf(sets[r.tree], asked[r.i - 1000], 3, 5, (0, 2), 1, only))


def test_boosting_matches_plain_rounds(spark):
    sets, asked = {1: [(x, y, 1) for x, y, _ in examples(7, 80)]}, [[a, b, 1] for a in range(5) for b in range(5)]
    half = lambda v: int(np.floor(abs(v) + 0.5)) * (1 if v >= 0 else -1)
    train, out = sets[1], [0] * len(asked)
    for k in range(4):
        depth, rate = (2, 0.3) if k else (0, 1.0)
        took = [half(rate * mean(plain_leaf(train, x, depth, 5, range(3)))) for x in [r[0] for r in train] + asked]
        out = [o + t for o, t in zip(out, took[len(train) :], strict=True)]
        train = [(x, y - t, w) for (x, y, w), t in zip(train, took, strict=False)]
    got = {r.i - 1000: r.fit for r in T.boosted(frame(spark, sets, asked), BY, 3, 0.3, 2, 5).collect()}
    assert [got[k] for k in range(len(asked))] == out


@pytest.mark.parametrize("window", [40, None])
def test_training_sets_are_purged_windows(spark, window):
    rows = spark.createDataFrame([("a", k) for k in range(1, 131)] + [("b", k) for k in range(1, 8)], "series_id string, i long")
    got = T.training_sets(rows, 50, 20, 5, window).collect()
    for s in range(61, 131, 20):
        own = sorted(r.i for r in got if r.s == s and r.w)
        assert own == list(range(max(1, s - 5 - window + 1) if window else 1, s - 5 + 1))
        assert [r.i for r in got if r.s == s and not r.w] == [s]
    assert {r.s for r in got} == set(range(61, 131, 20)) and {r.series_id for r in got} == {"a"}


def test_bins_come_from_training_rows(spark):
    rng = random.Random(3)
    values = [rng.randrange(20) for _ in range(50)]
    rows = spark.createDataFrame([(1, k, 1, v) for k, v in enumerate(values)] + [(1, 100 + k, 0, v) for k, v in enumerate((-5, 7, 500))], "s long, i long, w long, v long")
    got = {r.i: r.x[0] for r in T.with_bins(rows.withColumn("v", F.array("v")), ["s"], "v", 8).collect()}
    bounds = [sorted(values)[k * 50 // 8 - 1] for k in range(1, 8)]
    assert all(got[i] == sum(v > b for b in bounds) for i, v in [*enumerate(values), (100, -5), (101, 7), (102, 500)])


def test_small_systems_are_solved(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 4))
    x[:, 0] = 1
    y = x @ [1.0, -2.0, 0.5, 3.0] + rng.normal(size=40)
    rows = [("a", k, *map(float, r), float(v)) for k, (r, v) in enumerate(zip(x, y, strict=True))] + [("flat", k, 1.0, 2.0, 4.0, 1.0, 1.0) for k in range(9)]
    df = spark.createDataFrame(rows, "series_id string, d long, x0 double, x1 double, x2 double, x3 double, y double")
    terms = L.normal_terms([F.col(f"x{k}") for k in range(4)], F.col("y"))
    for ridge in (0.0, 0.1):
        got = L.solved(df.groupBy("series_id").agg(*(F.sum(t).alias(n) for n, t in terms.items())), 4, ridge)
        got = {r.series_id: [r[f"beta_{k}"] for k in range(4)] for r in got.collect()}
        want = np.linalg.solve(x.T @ x + ridge * len(x) * np.diag([0, 1, 1, 1]), x.T @ y)
        assert got["a"] == pytest.approx(want) and (ridge or got["flat"] == [None] * 4)
    sums = df.where("series_id = 'a'").withColumns(L.known_sums(df, {"t": F.col("y")}, 5, 10)).orderBy("d").collect()
    assert all(r.t == pytest.approx(sum(y[max(0, r.d - 14) : max(0, r.d - 4)]), abs=1e-9) for r in sums)


@pytest.mark.parametrize("name", ["ensemble_blend", "walkforward_trees"])
def test_later_prices_do_not_reach_earlier_rows(spark, sf_dir, tmp_path, name):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    second = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    cut = orders.agg(F.percentile_approx(second, 0.7)).first()[0]
    orders.withColumn("o_totalprice", F.when(second > cut, F.col("o_totalprice") * 3).otherwise(F.col("o_totalprice"))).write.parquet(str(tmp_path / "orders.parquet"))
    rows = []
    for d in (sf_dir, str(tmp_path)):
        got = catalogue.QUERIES[name](spark, d).where(F.unix_seconds(F.col("d").cast("timestamp")) <= cut).drop("actual").collect()
        rows.append({(r.series_id, r.d): r for r in got})
    assert rows[0] and all(rows[0][k] == rows[1][k] for k in rows[0].keys() & rows[1].keys()) and len(rows[0].keys() & rows[1].keys()) > 5


def test_members_are_trained_on_the_window_before_each_decision(spark, sf_dir):
    got = catalogue.QUERIES["walkforward_trees"](spark, sf_dir).collect()
    n = {r.series_id: r.n for r in learning.matrix(spark, sf_dir).withColumn("i", F.row_number().over(S.ordered())).groupBy("series_id").agg(F.max("i").alias("n")).collect()}
    assert len(got) == sum(len(range(1 + -(-evaluation.MIN_TRAIN // forests.STEP) * forests.STEP, k + 1, forests.STEP)) for k in n.values())
    assert all(r.n_train <= forests.WINDOW and len(r.chosen.split(",")) == 4 for r in got)
    for r in got:
        members = [r[m] for m in forests.MEMBERS]
        assert min(members) - 1e-6 <= r.ensemble <= max(members) + 1e-6


@pytest.mark.parametrize(
    ("evidence", "accuracy", "confidence", "drift", "reasons", "status"),
    [
        ("backtest", 39.4, 10.0, 3.55, ["low_direction_accuracy", "low_confidence", "high_feature_drift"], "unqualified"),
        ("backtest", 45.4, 31.7, 0.82, [], "qualified"),
        ("live", 49.9, 31.7, 0.82, ["low_direction_accuracy"], "unqualified"),
        ("live_sparse", 70.0, 31.7, 0.82, ["limited_samples"], "watch"),
        ("none", None, 31.7, 0.82, ["no_evaluation_evidence"], "watch"),
        ("backtest_sparse", 70.0, 14.0, 0.82, ["limited_samples", "low_confidence"], "unqualified"),
    ],
)
def test_grades(spark, evidence, accuracy, confidence, drift, reasons, status):
    row = spark.createDataFrame([(evidence, accuracy, confidence, drift)], "e string, a double, c double, d double").select(rules.grade_reasons(F.col("e"), F.col("a"), F.col("c"), F.col("d")).alias("why"))
    got = row.withColumn("status", rules.grade_status(F.col("why"))).first()
    assert got.why == reasons and got.status == status


@pytest.mark.parametrize("level", [0.65, 0.8, 0.87, 0.98])
def test_quantile_of_a_level_that_is_data(spark, level):
    values = sorted(np.random.default_rng(2).normal(size=37).tolist())
    got = spark.createDataFrame([(values, level), ([4.0], level)], "v array<double>, l double").select(evaluation.interpolated(F.col("v"), F.col("l")).alias("q")).collect()
    assert got[0].q == pytest.approx(np.quantile(values, level)) and got[1].q == 4.0
