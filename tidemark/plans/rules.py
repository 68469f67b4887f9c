"""Row-wise rules and text scores: quality grades, ensembles, news, risk regimes, payload checks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import series as S
from ..functions.series import clip, r6
from ..operators.bars import frames, table
from .evaluation import EVERY, LEDGER_SQL, PNL_SQL, STEPS, TRADES_SQL, WALK_SQL, drift_of, drift_sql, ledger, pnl, walk
from .learning import FEATURES, MATRIX_SQL, drift_scores
from .registry import query

LIVE_FROM = "2024-01-16 00:00:00"  # forecasts issued from then on are live, earlier ones are the backtest
# Samples that make evidence, least accuracies, confidence and drift of a grade.
LIVE_LEAST, TESTED_LEAST, LIVE_FLOOR, TESTED_FLOOR, SURE_LEAST, DRIFT_MOST = 10, 30, 50, 45, 15, 3.0

_HIT_SQL = "CASE WHEN actual IS NULL THEN NULL WHEN sign(pred - price) = sign(actual - price) THEN 1.0 ELSE 0.0 END"


GRADE_SQL = f"""{LEDGER_SQL}, g0 AS (SELECT *, pred - price AS move, issued_at >= TIMESTAMP '{LIVE_FROM}' AS live, {_HIT_SQL} AS hit, abs(actual - pred) / greatest(abs(actual), 1e-6) AS ape FROM led),
g AS (SELECT user_id, horizon, count(*) AS samples, count(actual) FILTER (WHERE live) AS live_total, count(actual) FILTER (WHERE NOT live) AS backtest_total, 100 * avg(hit) FILTER (WHERE live) AS live_accuracy, 100 * avg(hit) FILTER (WHERE NOT live) AS backtest_accuracy,
  avg(ape) FILTER (WHERE NOT live) AS error, avg(high - low) AS width, avg(price) AS price, {drift_sql('price', 'move')} AS drift_score FROM g0 GROUP BY 1, 2),
c0 AS (SELECT *, CASE WHEN live_total >= {LIVE_LEAST} THEN 'live' WHEN backtest_total >= {TESTED_LEAST} THEN 'backtest' WHEN live_total > 0 THEN 'live_sparse' WHEN backtest_total > 0 THEN 'backtest_sparse' ELSE 'none' END AS evidence,
  CASE WHEN backtest_total > 0 THEN 0.4 * greatest(0, least(1, 1 - error)) + 0.6 * backtest_accuracy / 100 ELSE 0.5 END AS base FROM g),
c AS (SELECT *, CASE WHEN evidence LIKE 'live%' THEN live_accuracy WHEN evidence LIKE 'backtest%' THEN backtest_accuracy END AS accuracy,
  round(least(95, greatest(10, least(95, greatest(10, 100 * base)) + 0.55 * (coalesce(nullif(backtest_accuracy, 0), 50) - 50) - least(45, 230 * greatest(0, width / greatest(1e-9, price))) - least(25, 10 * greatest(0, drift_score - 1.2)))), 6) AS confidence FROM c0)"""


def graded(spark, sf_dir):
    """Each user's horizon with its evidence, the accuracy observed by it, its drift and its confidence.

    Confidence starts at the backtest's skill and is corrected by its directions, the width of the intervals and the drift of what is forecast from.
    """
    y, p, c = F.col("actual"), F.col("pred"), F.col("price")
    rows = ledger(spark, sf_dir).withColumns({
        "move": p - c, "live": F.col("issued_at") >= F.lit(LIVE_FROM).cast("timestamp_ntz"), "hit": F.when(y.isNotNull(), (S.sign(p - c) == S.sign(y - c)).cast("double")), "ape": F.abs(y - p) / F.greatest(F.abs(y), F.lit(1e-6)),
    })
    live, tested = F.col("live"), ~F.col("live")
    g = rows.groupBy("user_id", "horizon").agg(
        F.count("*").alias("samples"), F.count(F.when(live, y)).alias("live_total"), F.count(F.when(tested, y)).alias("backtest_total"), (100 * F.avg(F.when(live, F.col("hit")))).alias("live_accuracy"), (100 * F.avg(F.when(tested, F.col("hit")))).alias("backtest_accuracy"),
        F.avg(F.when(tested, F.col("ape"))).alias("error"), F.avg(F.col("high") - F.col("low")).alias("width"), F.avg("price").alias("price"), drift_of("price", "move").alias("drift_score"),
    )
    n_live, n_tested, accuracy = F.col("live_total"), F.col("backtest_total"), F.col("backtest_accuracy")
    evidence = F.when(n_live >= LIVE_LEAST, "live").when(n_tested >= TESTED_LEAST, "backtest").when(n_live > 0, "live_sparse").when(n_tested > 0, "backtest_sparse").otherwise("none")
    base = F.when(n_tested > 0, 0.4 * clip(1 - F.col("error"), 0.0, 1.0) + 0.6 * accuracy / 100).otherwise(0.5)
    told = 0.55 * (F.coalesce(F.when(accuracy != 0, accuracy), F.lit(50.0)) - 50)
    wide = F.least(F.lit(45.0), 230 * F.greatest(F.lit(0.0), F.col("width") / F.greatest(F.lit(1e-9), c)))
    adrift = F.least(F.lit(25.0), 10 * F.greatest(F.lit(0.0), F.col("drift_score") - 1.2))
    g = g.withColumns({"evidence": evidence, "confidence": r6(clip(clip(100 * base, 10.0, 95.0) + told - wide - adrift, 10.0, 95.0))})
    return g.withColumn("accuracy", F.when(F.col("evidence").startswith("live"), F.col("live_accuracy")).when(F.col("evidence").startswith("backtest"), accuracy))


def grade_reasons(evidence, accuracy, confidence, drift):
    """Why a horizon isn't qualified, as an array in fixed order; empty for one that is."""
    floor = F.when(evidence.startswith("live"), LIVE_FLOOR).otherwise(TESTED_FLOOR)
    return F.array_compact(F.array(
        F.when(accuracy.isNull(), "no_evaluation_evidence").when(accuracy < floor, "low_direction_accuracy"), F.when(evidence.endswith("_sparse"), "limited_samples"), F.when(confidence < SURE_LEAST, "low_confidence"), F.when(drift > DRIFT_MOST, "high_feature_drift")
    ))


def grade_status(reasons):
    """``watch`` where nothing but evidence is wanting."""
    mild = F.forall(reasons, lambda r: r.isin("limited_samples", "no_evaluation_evidence"))
    return F.when(F.size(reasons) == 0, "qualified").when(mild, "watch").otherwise("unqualified")


@query(
    "quality_classification",
    f"""WITH {GRADE_SQL}, w AS (SELECT *, list_filter([CASE WHEN accuracy IS NULL THEN 'no_evaluation_evidence' WHEN accuracy < CASE WHEN evidence LIKE 'live%' THEN {LIVE_FLOOR} ELSE {TESTED_FLOOR} END THEN 'low_direction_accuracy' END, CASE WHEN evidence LIKE '%sparse' THEN 'limited_samples' END,
    CASE WHEN confidence < {SURE_LEAST} THEN 'low_confidence' END, CASE WHEN drift_score > {DRIFT_MOST} THEN 'high_feature_drift' END], lambda x: x IS NOT NULL) AS reasons FROM c)
    SELECT user_id, horizon, samples, live_total, backtest_total, round(accuracy, 4) AS direction_accuracy, round(drift_score, 4) AS drift_score, evidence, confidence, array_to_string(reasons, ',') AS reasons,
    CASE WHEN len(reasons) = 0 THEN 'qualified' WHEN len(list_filter(reasons, lambda x: x NOT IN ('limited_samples', 'no_evaluation_evidence'))) = 0 THEN 'watch' ELSE 'unqualified' END AS status FROM w""",
)
def quality_classification(spark, sf_dir):
    """Evidence, confidence and grade of each user's horizon by threshold rules."""
    g = graded(spark, sf_dir).withColumn("why", grade_reasons(F.col("evidence"), F.col("accuracy"), F.col("confidence"), F.col("drift_score")))
    return g.select(
        "user_id", "horizon", "samples", "live_total", "backtest_total", F.round("accuracy", 4).alias("direction_accuracy"), F.round("drift_score", 4).alias("drift_score"), "evidence", "confidence", F.array_join("why", ",").alias("reasons"), grade_status(F.col("why")).alias("status")
    )


@query(
    "headline_horizon",
    f"""WITH {GRADE_SQL} SELECT user_id, arg_max(horizon, row(CASE evidence WHEN 'live' THEN 2 WHEN 'backtest' THEN 1 ELSE 0 END, live_total, round(coalesce(accuracy, 0), 6), horizon)) AS headline, count(*) FILTER (WHERE evidence = 'live') AS live_horizons FROM c GROUP BY 1""",
)
def headline_horizon(spark, sf_dir):
    """The horizon to show first: by evidence, then by resolved forecasts and accuracy."""
    rank = F.when(F.col("evidence") == "live", 2).when(F.col("evidence") == "backtest", 1).otherwise(0)
    order = F.struct(rank, "live_total", r6(F.coalesce("accuracy", F.lit(0.0))), "horizon")
    return graded(spark, sf_dir).groupBy("user_id").agg(F.max_by("horizon", order).alias("headline"), F.count_if(F.col("evidence") == "live").alias("live_horizons"))


MEMBERS = ("drift", "price_5d_ago", "challenger")
SETTLED = -(-STEPS // EVERY)  # decision rows back to the last forecast whose outcome is known
RECENT = 20  # decision rows of the latest evaluation
# A leader's least accuracy, the weakest evidence, drift and weight of the challenger's blend.
LEADER_LEAST, AGREED_LEAST, DRIFT_LEAST, LEAN_MOST = 52, 0.55, 2.5, 0.45


def _z_sql(f):
    return f"abs(least(8, greatest(-8, ({f} - avg({f}) OVER e) / nullif(stddev_samp({f}) OVER e, 0))))"


_ZS = [_z_sql(f) for f in FEATURES]
BLEND_SQL = f"""{WALK_SQL}, {MATRIX_SQL[MATRIX_SQL.index("x AS (") :]},
dz AS (SELECT series_id, d, ({' + '.join(f'coalesce({z}, 0)' for z in _ZS)}) / nullif({' + '.join(f'CAST({z} IS NOT NULL AS INTEGER)' for z in _ZS)}, 0) AS drift_score FROM mx {frames()}),
s0 AS (SELECT *, CASE WHEN sign(pred - close) = sign(actual - close) THEN 1 ELSE 0 END AS hit, abs(actual - pred) / greatest(abs(actual), 1e-6) AS ape FROM models WHERE model <> 'naive'),
s1 AS (SELECT *, count(*) OVER k AS n, sum(hit) OVER k AS hits, avg(ape) OVER k AS mape FROM s0 WINDOW k AS (PARTITION BY series_id, model ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND {SETTLED} PRECEDING)),
j AS (SELECT series_id, d, model, close AS ref, pred, actual, CASE WHEN n > 0 THEN 100.0 * hits / n ELSE 50.0 END AS acc, CASE WHEN n > 0 THEN least(1.0, greatest(0.3, 0.4 * greatest(0, least(1, 1 - mape)) + 0.6 * hits / n)) ELSE 0.5 END AS w, CASE model WHEN 'drift' THEN 0 WHEN 'price_5d_ago' THEN 1 ELSE 2 END AS o FROM s1),
g AS (SELECT series_id, d, any_value(ref) AS ref, any_value(actual) AS actual, max(pred) FILTER (WHERE model = 'challenger') AS steady, sum(w * pred) / sum(w) AS ens, abs(sum(w * sign(pred - ref))) / sum(w) AS consensus, sum(w * acc) / sum(w) AS avg_acc, arg_max(model, row(acc, -o)) AS leader, arg_max(pred, row(acc, -o)) AS lead_pred, max(acc) AS lead_acc, stddev_pop(pred) AS spread FROM j GROUP BY 1, 2),
a AS (SELECT *, CASE WHEN sign(ens - ref) * sign(lead_pred - ref) = -1 AND lead_acc >= {LEADER_LEAST} THEN 0.2 + 0.35 * least(1, greatest(0, (lead_acc - 50) / 25)) ELSE 0 END AS blend, CASE WHEN sign(ens - ref) = sign(actual - ref) THEN 1.0 ELSE 0.0 END AS ens_hit FROM g),
z AS (SELECT *, least(1, greatest(0.35, (0.35 + 0.65 * consensus) * (0.45 + 0.55 * least(1, greatest(0, avg_acc / 100))))) AS shrink, coalesce(nullif(100 * avg(ens_hit) OVER (PARTITION BY series_id ORDER BY d ROWS BETWEEN {RECENT + SETTLED - 1} PRECEDING AND {SETTLED} PRECEDING), 0), 50.0) AS recent FROM a),
bl AS (SELECT z.*, drift_score, ref + ((1 - blend) * ens + blend * lead_pred - ref) * shrink AS stable, least({LEAN_MOST}, CASE WHEN recent < 50 THEN 0.12 + 0.23 * least(1, greatest(0, (50 - recent) / 15)) ELSE 0 END + CASE WHEN consensus < {AGREED_LEAST} THEN 0.12 ELSE 0 END + CASE WHEN coalesce(drift_score, 0) > {DRIFT_LEAST} THEN 0.08 ELSE 0 END) AS lean FROM z LEFT JOIN dz USING (series_id, d)),
blended AS (SELECT *, (1 - lean) * stable + lean * steady AS forecast FROM bl)"""


def blended(spark, sf_dir):
    """Decision rows with the ensemble of three models, stabilised and leaned towards recent drift, by skill known at each row.

    A model's weight and accuracy come from its forecasts that have matured by the row, those of the last ``RECENT`` decision rows tell how
    well the ensemble itself did; before the first outcome they are even. The frames end before the row, so later prices can't reach it.
    """
    ref, pred, acc, w, y = F.col("ref"), F.col("pred"), F.col("acc"), F.col("w"), F.col("actual")
    order = F.when(F.col("model") == "drift", 0).when(F.col("model") == "price_5d_ago", 1).otherwise(2)
    rows = walk(spark, sf_dir).unpivot(["series_id", "d", "close", "actual"], list(MEMBERS), "model", "pred").withColumnRenamed("close", "ref")
    rows = rows.withColumns({"hit": (S.sign(pred - ref) == S.sign(y - ref)).cast("double"), "ape": F.abs(y - pred) / F.greatest(F.abs(y), F.lit(1e-6)), "o": order})
    known = Window.partitionBy("series_id", "model").orderBy("d").rowsBetween(Window.unboundedPreceding, -SETTLED)
    hits, error = F.avg("hit").over(known), F.avg("ape").over(known)
    rows = rows.withColumns({"acc": F.coalesce(100 * hits, F.lit(50.0)), "w": F.coalesce(clip(0.4 * clip(1 - error, 0.0, 1.0) + 0.6 * hits, 0.3, 1.0), F.lit(0.5))})
    best, total = F.struct(acc, -F.col("o")), F.sum(w)
    g = rows.groupBy("series_id", "d").agg(
        F.first("ref").alias("ref"), F.first("actual").alias("actual"), F.max(F.when(F.col("model") == "challenger", pred)).alias("steady"), (F.sum(w * pred) / total).alias("ens"), (F.abs(F.sum(w * S.sign(pred - ref))) / total).alias("consensus"), (F.sum(w * acc) / total).alias("avg_acc"),
        F.max_by("model", best).alias("leader"), F.max_by("pred", best).alias("lead_pred"), F.max("acc").alias("lead_acc"), F.stddev_pop("pred").alias("spread"),
    )
    ens, lead = F.col("ens"), F.col("lead_pred")
    lately = S.ordered().rowsBetween(1 - RECENT - SETTLED, -SETTLED)
    own = 100 * F.avg((S.sign(ens - ref) == S.sign(y - ref)).cast("double")).over(lately)
    blend = F.when((S.sign(ens - ref) * S.sign(lead - ref) == -1) & (F.col("lead_acc") >= LEADER_LEAST), 0.2 + 0.35 * clip((F.col("lead_acc") - 50) / 25, 0.0, 1.0)).otherwise(0.0)
    shrink = clip((0.35 + 0.65 * F.col("consensus")) * (0.45 + 0.55 * clip(F.col("avg_acc") / 100, 0.0, 1.0)), 0.35, 1.0)
    g = g.withColumns({"recent": F.coalesce(F.when(own != 0, own), F.lit(50.0)), "shrink": shrink, "blend": blend}).join(drift_scores(spark, sf_dir), ["series_id", "d"], "left")
    recent = F.col("recent")
    lean = F.when(recent < 50, 0.12 + 0.23 * clip((50 - recent) / 15, 0.0, 1.0)).otherwise(0.0) + F.when(F.col("consensus") < AGREED_LEAST, 0.12).otherwise(0.0) + F.when(F.coalesce("drift_score", F.lit(0.0)) > DRIFT_LEAST, 0.08).otherwise(0.0)
    b = F.col("blend")
    g = g.withColumns({"stable": ref + ((1 - b) * ens + b * lead - ref) * F.col("shrink"), "lean": F.least(F.lit(LEAN_MOST), lean)})
    return g.withColumn("forecast", (1 - F.col("lean")) * F.col("stable") + F.col("lean") * F.col("steady"))


@query(
    "ensemble_blend",
    f"""WITH {BLEND_SQL} SELECT series_id, d, leader, round(consensus, 12) AS consensus, round(shrink, 6) AS shrink_factor, round((stable - ref) / nullif(ref, 0), 6) AS move, round(spread / nullif(ref, 0), 6) AS dispersion, round(drift_score, 6) AS drift_score,
    round(lean, 6) AS challenger_weight, round((forecast - ref) / nullif(ref, 0), 6) AS blended_move FROM blended""",
)
def ensemble_blend(spark, sf_dir):
    """Weighted ensemble of three models by skill so far, leaned to the best one when signs differ, shrunk by disagreement, then blended with recent drift where evidence is weak."""
    share = lambda v: r6(F.try_divide(v, F.col("ref")))
    return blended(spark, sf_dir).select(
        "series_id", "d", "leader", F.round("consensus", 12).alias("consensus"), r6(F.col("shrink")).alias("shrink_factor"), share(F.col("stable") - F.col("ref")).alias("move"), share(F.col("spread")).alias("dispersion"), r6(F.col("drift_score")).alias("drift_score"),
        r6(F.col("lean")).alias("challenger_weight"), share(F.col("forecast") - F.col("ref")).alias("blended_move"),
    )


@query(
    "ensemble_blend_metrics",
    f"""WITH {BLEND_SQL}, f AS (SELECT series_id, ref, actual, unnest(['ensemble', 'stabilised', 'blended']) AS model, unnest([ens, stable, forecast]) AS p FROM blended)
    SELECT series_id, model, count(*) AS n, round(avg(abs(actual - p)), 2) AS mae, round(sqrt(avg((actual - p) ** 2)), 2) AS rmse, round(100 * avg(CASE WHEN sign(p - ref) = sign(actual - ref) THEN 1.0 ELSE 0.0 END), 4) AS direction_accuracy FROM f GROUP BY 1, 2""",
)
def ensemble_blend_metrics(spark, sf_dir):
    """Errors and directions of the ensemble as it is, stabilised, and blended, over all decision rows."""
    rows = blended(spark, sf_dir).select("series_id", "ref", "actual", F.col("ens").alias("ensemble"), F.col("stable").alias("stabilised"), F.col("forecast").alias("blended"))
    y, p, ref = F.col("actual"), F.col("p"), F.col("ref")
    return rows.unpivot(["series_id", "ref", "actual"], ["ensemble", "stabilised", "blended"], "model", "p").groupBy("series_id", "model").agg(
        F.count("*").alias("n"), F.round(F.avg(F.abs(y - p)), 2).alias("mae"), F.round(F.sqrt(F.avg((y - p) * (y - p))), 2).alias("rmse"), F.round(100 * F.avg((S.sign(p - ref) == S.sign(y - ref)).cast("double")), 4).alias("direction_accuracy")
    )


@query(
    "ab_verdict",
    f"""WITH {TRADES_SQL}, ta AS (SELECT series_id, 'challenger' AS config, pnl FROM trades), tb AS (SELECT series_id, 'drift' AS config, round(sign(drift - close) * (actual - close) * 10.0 - 100.0, 2) AS pnl FROM walk WHERE sign(drift - close) <> 0),
    sa AS (SELECT series_id, config, avg(pnl) / nullif(stddev_samp(pnl), 0) * sqrt(252.0 / 5) AS sharpe FROM (FROM ta UNION ALL FROM tb) GROUP BY 1, 2),
    pv AS (SELECT series_id, max(sharpe) FILTER (WHERE config = 'challenger') AS a, max(sharpe) FILTER (WHERE config = 'drift') AS b FROM sa GROUP BY 1)
    SELECT series_id, round(a, 6) AS sharpe_challenger, round(b, 6) AS sharpe_drift, CASE WHEN a - b > 0.5 THEN 'risk' WHEN a >= b - 0.5 THEN 'clean' ELSE 'worse' END AS verdict FROM pv""",
)
def ab_verdict(spark, sf_dir):
    """One pipeline under two configurations, compared by Sharpe ratio."""
    rows = walk(spark, sf_dir).unpivot(["series_id", "d", "close", "actual"], ["challenger", "drift"], "config", "pred")
    side = S.sign(F.col("pred") - F.col("close"))
    rows = rows.where(side != 0).withColumn("pnl", F.round(side * (F.col("actual") - F.col("close")) * 10.0 - 100.0, 2))
    std = F.stddev_samp("pnl")
    wide = rows.groupBy("series_id").pivot("config", ["challenger", "drift"]).agg(F.avg("pnl") / F.when(std > 0, std) * F.sqrt(F.lit(252.0 / 5)))
    gap = F.col("challenger") - F.col("drift")
    verdict = F.when(gap > 0.5, "risk").when(gap >= -0.5, "clean").otherwise("worse")
    return wide.select("series_id", r6(F.col("challenger")).alias("sharpe_challenger"), r6(F.col("drift")).alias("sharpe_drift"), verdict.alias("verdict"))


@query(
    "account_scale",
    f"""WITH {PNL_SQL} SELECT series_id, n, CASE WHEN abs(total_pnl) >= 1e6 THEN format('{{:.1f}}M', total_pnl / 1e6) WHEN abs(total_pnl) >= 1e3 THEN format('{{:.1f}}K', total_pnl / 1e3) ELSE format('{{:.0f}}', total_pnl) END AS shown FROM p""",
)
def account_scale(spark, sf_dir):
    """Totals as people read them: millions and thousands by suffix."""
    x = F.col("total_pnl")
    shown = F.when(F.abs(x) >= 1e6, F.format_string("%.1fM", x / 1e6)).when(F.abs(x) >= 1e3, F.format_string("%.1fK", x / 1e3)).otherwise(F.format_string("%.0f", x))
    return pnl(spark, sf_dir).select("series_id", "n", shown.alias("shown"))


# Words that count for and against, of doubt and of outlook; each counts once where it occurs as a substring.
POSITIVE = ["rise", "gain", "up", "higher", "surge", "boost", "strong", "increase", "rally", "bullish", "jump", "soar", "climb", "recover", "spike", "breakout", "demand", "supply cut", "shortage", "opec cut", "production cut"]
NEGATIVE = ["fall", "drop", "down", "lower", "decline", "weak", "decrease", "plunge", "bearish", "crash", "slump", "tumble", "sink", "collapse", "slide", "oversupply", "glut", "recession", "demand drop", "production increase"]
UNCERTAIN = ["uncertain", "uncertainty", "risk", "volatile", "volatility", "war", "sanction", "tariff", "disruption", "tension", "conflict", "shock"]
FORWARD = ["outlook", "forecast", "expected", "expects", "guidance", "next week", "next month", "ahead", "future", "projection", "scenario", "target"]
INTENSE = ["sharply", "significantly", "strongly", "materially", "dramatically", "severely", "massively", "rapidly", "heavily", "aggressively"]
# Categories of risk, their words and their weights in the score.
RISKS = {
    "iran": (["iran", "hormuz", "tehran", "iranian", "persian gulf", "irgc"], 0.4),
    "opec": (["opec", "opec+", "saudi", "riyadh", "aramco", "production cut", "quota"], 0.3),
    "conflict": (["conflict", "attack", "strike", "houthi", "tanker", "blockade", "militia", "war"], 0.2),
    "sanctions": (["sanction", "embargo", "restriction", "tariff", "export ban"], 0.1),
}


def _count_sql(words):
    return "(" + " + ".join(f"CAST(contains(t, '{w}') AS INTEGER)" for w in words) + ")"


def _count(text, words):
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words[1:]), F.contains(text, F.lit(words[0])).cast("int"))


ARTICLES, FRESH = 20, 5
NEWS_SQL = f"""a AS (SELECT source, doc_id, lower(text) AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS place FROM documents WHERE lang = 'en'),
k AS (SELECT source, place, {_count_sql(POSITIVE)} - {_count_sql(NEGATIVE)} AS score, {_count_sql(UNCERTAIN)} AS doubt, {_count_sql(FORWARD)} AS ahead, {_count_sql(INTENSE)} AS intense, CASE WHEN place <= {FRESH} THEN 2.0 ELSE 1.0 END AS w,
  count(*) OVER (PARTITION BY source) AS n FROM a WHERE place <= {ARTICLES})"""


@query(
    "news_sentiment",
    f"""WITH {NEWS_SQL} SELECT source, CAST(max(n) AS BIGINT) AS n, round(sum(w * score) / sum(w), 6) AS sentiment_score, round(sum(w * doubt) / sum(w), 6) AS uncertainty_score, round(sum(w * ahead) / sum(w), 6) AS forwardness_score, round(sum(w * intense) / sum(w), 6) AS intensity_score,
    round(coalesce(avg(score) FILTER (WHERE place <= n // 2) - avg(score) FILTER (WHERE place > n // 2), 0), 6) AS sentiment_momentum, round(coalesce(count(*) FILTER (WHERE score > 0) * 1.0 / nullif(count(*) FILTER (WHERE score <> 0), 0), 0.5), 6) AS bullish_ratio,
    round(least(100, greatest(0, 50 + 5 * sum(w * score) / sum(w))), 6) AS market_buzz FROM k GROUP BY 1""",
)
def news_sentiment(spark, sf_dir):
    """Keyword sentiment of each source's newest articles, the newest five at double weight; the newest twenty are the feature."""
    newest = Window.partitionBy("source").orderBy(F.desc("doc_id"))
    rows = table(spark, sf_dir, "documents").where("lang = 'en'").withColumn("place", F.row_number().over(newest)).where(F.col("place") <= ARTICLES)
    text = F.lower("text")
    rows = rows.select(
        "source", "place", (_count(text, POSITIVE) - _count(text, NEGATIVE)).alias("score"), _count(text, UNCERTAIN).alias("doubt"), _count(text, FORWARD).alias("ahead"), _count(text, INTENSE).alias("intense"),
        F.when(F.col("place") <= FRESH, 2.0).otherwise(1.0).alias("w"), F.count("*").over(Window.partitionBy("source")).alias("n"),
    )
    score, w, half = F.col("score"), F.col("w"), F.expr("n div 2")
    mean = lambda c: F.sum(w * F.col(c)) / F.sum(w)
    momentum = F.avg(F.when(F.col("place") <= half, score)) - F.avg(F.when(F.col("place") > half, score))
    told = F.count_if(score != 0)
    return rows.groupBy("source").agg(
        F.max("n").alias("n"), r6(mean("score")).alias("sentiment_score"), r6(mean("doubt")).alias("uncertainty_score"), r6(mean("ahead")).alias("forwardness_score"), r6(mean("intense")).alias("intensity_score"), r6(F.coalesce(momentum, F.lit(0.0))).alias("sentiment_momentum"),
        r6(F.coalesce(F.count_if(score > 0) / F.when(told > 0, told), F.lit(0.5))).alias("bullish_ratio"), r6(clip(50 + 5 * mean("score"), 0.0, 100.0)).alias("market_buzz"),
    )


NOW = "2024-01-30 00:00:00"
AGE_SQL = "CASE WHEN age < 6 THEN 2.0 WHEN age < 24 THEN 1.0 WHEN age < 72 THEN 0.5 WHEN age < 168 THEN 0.25 ELSE 0.1 END"
GEO_SQL = f"""a AS (SELECT d.source, d.doc_id, lower(d.text) AS t, (epoch(TIMESTAMP '{NOW}') - epoch(e.ts)) / 3600 AS age FROM documents d JOIN events e ON e.event_id = d.doc_id),
m AS (SELECT source, doc_id, {AGE_SQL} AS w, unnest([{', '.join(f"CASE WHEN {_count_sql(words)} > 0 THEN '{k}' END" for k, (words, _) in RISKS.items())}]) AS category FROM a),
g AS (SELECT source, {', '.join(f"count(*) FILTER (WHERE category = '{k}') AS {k}_articles, coalesce(sum(w) FILTER (WHERE category = '{k}'), 0) AS {k}_w" for k in RISKS)}, count(DISTINCT doc_id) AS scanned FROM m GROUP BY 1),
s AS (SELECT *, round(100 * ({' + '.join(f'least(1.0, {k}_w / 10.0) * {x}' for k, (_, x) in RISKS.items())}), 4) AS score FROM g)"""


@query(
    "geo_regime",
    f"""WITH {GEO_SQL} SELECT source, scanned, {', '.join(f'{k}_articles' for k in RISKS)}, score AS geo_risk_score, CASE WHEN score >= 65 THEN 'CRITICAL' WHEN score >= 40 THEN 'HIGH' WHEN score >= 15 THEN 'ELEVATED' ELSE 'LOW' END AS regime,
    CASE WHEN greatest({', '.join(f'{k}_articles' for k in RISKS)}) = 0 THEN 'none' {' '.join(f"WHEN {k}_articles = greatest({', '.join(f'{j}_articles' for j in RISKS)}) THEN '{k}'" for k in RISKS)} END AS dominant_driver FROM s""",
)
def geo_regime(spark, sf_dir):
    """Risk of each source's articles by keyword category, weighted by age, and the regime it means."""
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), "ts")
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", "text").join(events, "doc_id")
    text = F.lower("text")
    age = (F.unix_micros(F.lit(NOW).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 3.6e9
    w = F.when(age < 6, 2.0).when(age < 24, 1.0).when(age < 72, 0.5).when(age < 168, 0.25).otherwise(0.1)
    rows = rows.select("source", "doc_id", w.alias("w"), *((_count(text, words) > 0).alias(k) for k, (words, _) in RISKS.items()))
    aggs = [x for k in RISKS for x in (F.count_if(k).alias(f"{k}_articles"), F.coalesce(F.sum(F.when(F.col(k), F.col("w"))), F.lit(0.0)).alias(f"{k}_w"))]
    g = rows.groupBy("source").agg(*aggs, F.count_distinct("doc_id").alias("scanned"))
    score = F.round(100 * sum((F.least(F.lit(1.0), F.col(f"{k}_w") / 10.0) * x for k, (_, x) in RISKS.items()), F.lit(0.0)), 4)
    most = F.greatest(*(F.col(f"{k}_articles") for k in RISKS))
    lead = F.when(most == 0, "none")
    for k in RISKS:
        lead = lead.when(F.col(f"{k}_articles") == most, k)
    g = g.withColumns({"geo_risk_score": score, "dominant_driver": lead})
    s = F.col("geo_risk_score")
    regime = F.when(s >= 65, "CRITICAL").when(s >= 40, "HIGH").when(s >= 15, "ELEVATED").otherwise("LOW")
    return g.select("source", "scanned", *(f"{k}_articles" for k in RISKS), "geo_risk_score", regime.alias("regime"), "dominant_driver")


PAYLOAD_SQL = """p AS (SELECT user_id, CASE WHEN user_id % 7 = 0 THEN -1.0 WHEN user_id % 11 = 0 THEN 'NaN'::DOUBLE ELSE max(value) END AS current_price, CASE WHEN user_id % 5 = 0 THEN NULL ELSE max(ts) END AS frozen_at, CASE WHEN user_id % 13 = 0 THEN ' ' ELSE 'CL' || user_id END AS symbol,
  max(value) AS prediction, max(value) * CASE WHEN user_id % 3 = 0 THEN 1.05 ELSE 0.9 END AS low, max(value) * 1.02 AS high, list(ts ORDER BY ts, event_id) AS stamps, list(value ORDER BY ts, event_id)[:CASE WHEN user_id % 17 = 0 THEN 1 ELSE count(*) END] AS vals FROM events GROUP BY user_id),
l AS (SELECT max(ts) AS now FROM events)"""


@query(
    "payload_validation",
    f"""WITH {PAYLOAD_SQL}, v AS (SELECT user_id, list_filter([CASE WHEN current_price IS NULL OR isnan(current_price) OR isinf(current_price) OR current_price <= 0 THEN 'current_price must be a finite positive number' END,
    CASE WHEN frozen_at IS NULL THEN 'frozen_at must be a timestamp' WHEN epoch(now) - epoch(frozen_at) > 43200 THEN 'frozen_at is older than 720 minutes' END, CASE WHEN trim(symbol) = '' THEN 'contract.symbol must be present' END,
    CASE WHEN low > high THEN 'lower exceeds upper' WHEN prediction < low OR prediction > high THEN 'prediction lies outside its interval' END, CASE WHEN len(stamps) <> len(vals) THEN 'timestamps and values must be aligned' WHEN len(stamps) = 0 THEN 'history must not be empty' END], lambda x: x IS NOT NULL) AS bad FROM p, l)
    SELECT user_id, CAST(len(bad) AS INTEGER) AS n_violations, array_to_string(bad, '; ') AS violations FROM v""",
)
def payload_validation(spark, sf_dir):
    """Rules a published payload must keep, as a list of the messages of those it breaks; payloads are made from events, some of them faulty."""
    events, u = table(spark, sf_dir, "events"), F.col("user_id")
    top, n = F.max("value"), F.count("*")
    p = events.groupBy("user_id").agg(
        F.when(u % 7 == 0, -1.0).when(u % 11 == 0, float("nan")).otherwise(top).alias("current_price"), F.when(u % 5 == 0, None).otherwise(F.max("ts")).alias("frozen_at"),
        F.when(u % 13 == 0, " ").otherwise(F.concat(F.lit("CL"), u.cast("string"))).alias("symbol"), top.alias("prediction"), (top * F.when(u % 3 == 0, 1.05).otherwise(0.9)).alias("low"), (top * 1.02).alias("high"),
        n.alias("stamps"), F.when(u % 17 == 0, F.least(n, F.lit(1))).otherwise(n).alias("vals"),
    )
    now = events.agg(F.max("ts").alias("now"))
    price, age = S.finite(F.col("current_price")), F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("frozen_at").cast("timestamp"))
    rules = [
        F.when(price.isNull() | (price <= 0), "current_price must be a finite positive number"),
        F.when(F.col("frozen_at").isNull(), "frozen_at must be a timestamp").when(age > 43200 * 10**6, "frozen_at is older than 720 minutes"),
        F.when(F.trim("symbol") == "", "contract.symbol must be present"),
        F.when(F.col("low") > F.col("high"), "lower exceeds upper").when(~F.col("prediction").between(F.col("low"), F.col("high")), "prediction lies outside its interval"),
        F.when(F.col("stamps") != F.col("vals"), "timestamps and values must be aligned").when(F.col("stamps") == 0, "history must not be empty"),
    ]
    bad = p.join(F.broadcast(now)).withColumn("bad", F.array_compact(F.array(*rules)))
    return bad.select("user_id", F.size("bad").alias("n_violations"), F.array_join("bad", "; ").alias("violations"))
