"""Models fitted anew at each decision row of a walk-forward, and volatility models with an implied series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import linear as L
from ..functions import series as S
from ..functions import stats as T
from ..functions.series import clip, r2, r6
from .evaluation import COST, EVERY, HAR_SQL, MIN_TRAIN, SIZE, STEPS, har_fits, har_rows
from .joins import PANEL_SQL, panel
from .learning import FEATURES, MATRIX_SQL, matrix
from .registry import query

ROLLING = 252  # rows of a rolling training window
MODELS = ("return_5", "volatility_20", "zscore_20")  # each is the one regressor of a model
TRAININGS = ("expanding", "rolling")


def _fits_sql(training):
    reach = "UNBOUNDED" if training == "expanding" else str(ROLLING + STEPS - 1)
    own = ", ".join(f"regr_intercept(target, {m}) OVER p + regr_slope(target, {m}) OVER p * {m} AS {m}_p, greatest(0.05, coalesce(regr_r2(target, {m}) OVER p, 0)) AS {m}_w" for m in MODELS)
    return f"SELECT series_id, d, close, target, '{training}' AS training, row_number() OVER (PARTITION BY series_id ORDER BY d) AS i, count(*) OVER p AS n_train, {own} FROM mx WINDOW p AS (PARTITION BY series_id ORDER BY d ROWS BETWEEN {reach} PRECEDING AND {STEPS} PRECEDING)"


_P, _W = [f"{m}_p" for m in MODELS], [f"{m}_w" for m in MODELS]
REFIT_SQL = f"""{MATRIX_SQL}, f0 AS ({_fits_sql('expanding')} UNION ALL {_fits_sql('rolling')}), f AS (SELECT *, ({' + '.join(f'{p} * {w}' for p, w in zip(_P, _W, strict=True))}) / ({' + '.join(_W)}) AS ensemble FROM f0 WHERE i > {MIN_TRAIN} AND (i - 1) % {EVERY} = 0),
rf AS (SELECT *, close * (1 + ensemble) AS forecast, close * (1 + target) AS actual FROM f WHERE ensemble IS NOT NULL)"""


def _decisions(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("i") > MIN_TRAIN) & ((F.col("i") - 1) % EVERY == 0))


def trained(rows: DataFrame, terms: dict) -> DataFrame:
    """Decision rows of ``rows`` once for each training, with the sums of ``terms`` over the rows it knows by then."""
    sums = {t: L.known_sums(rows, terms, STEPS, None if t == "expanding" else ROLLING) for t in TRAININGS}
    rows = _decisions(rows.withColumns({f"{t}_{name}": c for t in TRAININGS for name, c in sums[t].items()}))
    each = F.array(*(F.struct(F.lit(t).alias("training"), *(F.col(f"{t}_{name}").alias(name) for name in terms)) for t in TRAININGS))
    own = [c for c in rows.columns if c not in {f"{t}_{name}" for t in TRAININGS for name in terms}]
    return rows.select(*own, F.explode(each).alias("fit")).select(*own, "fit.*")


def refits(spark, sf_dir) -> DataFrame:
    """Decision rows with the forecasts of three regressions, each fitted anew on expanding and on rolling rows known by then, and of their ensemble.

    Fits come from running sums, both trainings from the same ones. A model weighs as much as its fit in training is good.
    """
    rows = matrix(spark, sf_dir).withColumn("i", F.row_number().over(S.ordered()))
    rows = rows.withColumns({f"{m}_c": L.centred(m) for m in MODELS})
    y, terms = F.col("target"), {"n": F.lit(1.0), "sy": F.col("target"), "syy": F.col("target") * F.col("target")}
    for m in MODELS:
        x = F.col(f"{m}_c")
        terms |= {f"{m}_x": x, f"{m}_xx": x * x, f"{m}_xy": x * y}
    out, n, sy = trained(rows, terms), F.col("n"), F.col("sy")
    for m in MODELS:
        sx = F.col(f"{m}_x")
        out = out.withColumns({f"{m}_vx": F.col(f"{m}_xx") - sx * sx / n, f"{m}_cov": F.col(f"{m}_xy") - sx * sy / n})
        vx, cov, vy = F.col(f"{m}_vx"), F.col(f"{m}_cov"), F.col("syy") - sy * sy / n
        fit = F.when((n > 1) & (vx > 0), sy / n + cov / F.when(vx > 0, vx) * (F.col(f"{m}_c") - sx / n))
        out = out.withColumns({f"{m}_p": fit, f"{m}_w": F.greatest(F.lit(0.05), F.coalesce(F.try_divide(cov * cov, F.when(vx > 0, vx) * vy), F.lit(0.0)))})
    total = sum((F.col(w) for w in _W[1:]), F.col(_W[0]))
    out = out.withColumn("ensemble", sum((F.col(p) * F.col(w) for p, w in zip(_P, _W, strict=True)), F.lit(0.0)) / total).where("ensemble IS NOT NULL")
    return out.withColumns({"n_train": F.col("n").cast("long"), "forecast": F.col("close") * (1 + F.col("ensemble")), "actual": F.col("close") * (1 + y)})


@query("walkforward_refit", f"WITH {REFIT_SQL} SELECT series_id, d, training, n_train, round(close, 2) AS reference, {', '.join(f'round({p}, 6) AS {m}_forecast' for m, p in zip(MODELS, _P, strict=True))}, round(ensemble, 6) AS ensemble_forecast, round(actual, 2) AS actual FROM rf")
def walkforward_refit(spark, sf_dir):
    return refits(spark, sf_dir).select(
        "series_id", "d", "training", "n_train", r2(F.col("close")).alias("reference"), *(r6(F.col(f"{m}_p")).alias(f"{m}_forecast") for m in MODELS), r6(F.col("ensemble")).alias("ensemble_forecast"), r2(F.col("actual")).alias("actual")
    )


@query(
    "walkforward_refit_metrics",
    f"""WITH {REFIT_SQL}, t AS (SELECT *, sign(forecast - close) AS dir, CASE WHEN sign(forecast - close) <> 0 THEN round(sign(forecast - close) * (actual - close) * {SIZE} - {COST}, 2) END AS pnl FROM rf)
    SELECT series_id, training, CAST(year(d) AS INTEGER) AS year, count(*) AS n, round(avg(abs(actual - forecast)), 2) AS mae, round(sqrt(avg((actual - forecast) ** 2)), 2) AS rmse, round(avg(abs(actual - close)), 2) AS mae_naive,
    round(100 * avg(CASE WHEN dir = sign(actual - close) THEN 1.0 ELSE 0.0 END), 4) AS direction_accuracy, count(pnl) AS n_trades, round(sum(pnl), 2) AS total_pnl, round(avg(pnl) / nullif(stddev_samp(pnl), 0) * sqrt(252.0 / {STEPS}), 4) AS sharpe FROM t GROUP BY 1, 2, 3""",
)
def walkforward_refit_metrics(spark, sf_dir):
    """Errors, directions and trades of the refitted ensemble by year, with expanding and with rolling training."""
    c, y, p = F.col("close"), F.col("actual"), F.col("forecast")
    side = S.sign(p - c)
    pnl = F.when(side != 0, F.round(side * (y - c) * SIZE - COST, 2))
    std = F.stddev_samp(pnl)
    return refits(spark, sf_dir).groupBy("series_id", "training", F.year("d").alias("year")).agg(
        F.count("*").alias("n"), r2(F.avg(F.abs(y - p))).alias("mae"), r2(F.sqrt(F.avg((y - p) * (y - p)))).alias("rmse"), r2(F.avg(F.abs(y - c))).alias("mae_naive"),
        F.round(100 * F.avg((side == S.sign(y - c)).cast("double")), 4).alias("direction_accuracy"), F.count(pnl).alias("n_trades"), r2(F.sum(pnl)).alias("total_pnl"),
        F.round(F.avg(pnl) / F.when(std > 0, std) * F.sqrt(F.lit(252.0 / STEPS)), 4).alias("sharpe"),
    )


@query(
    "training_ab",
    f"""WITH {REFIT_SQL}, t AS (SELECT series_id, training, round(sign(forecast - close) * (actual - close) * {SIZE} - {COST}, 2) AS pnl, sign(forecast - close) = sign(actual - close) AS hit FROM rf WHERE sign(forecast - close) <> 0),
    s AS (SELECT series_id, training, avg(pnl) / nullif(stddev_samp(pnl), 0) * sqrt(252.0 / {STEPS}) AS sharpe, 100 * avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS acc FROM t GROUP BY 1, 2),
    v AS (SELECT series_id, max(sharpe) FILTER (WHERE training = 'expanding') AS a, max(sharpe) FILTER (WHERE training = 'rolling') AS b, max(acc) FILTER (WHERE training = 'rolling') AS acc FROM s GROUP BY 1)
    SELECT series_id, round(a, 4) AS sharpe_expanding, round(b, 4) AS sharpe_rolling, round(acc, 4) AS accuracy_rolling, CASE WHEN b >= a - 0.5 AND acc >= 50 THEN 'clean' WHEN a - b > 0.5 THEN 'risk' ELSE 'weak' END AS verdict FROM v""",
)
def training_ab(spark, sf_dir):
    """The same walk-forward under two trainings, compared by Sharpe ratio and accuracy."""
    c, y = F.col("close"), F.col("actual")
    side = S.sign(F.col("forecast") - c)
    rows = refits(spark, sf_dir).where(side != 0).select("series_id", "training", F.round(side * (y - c) * SIZE - COST, 2).alias("pnl"), (side == S.sign(y - c)).alias("hit"))
    std = F.stddev_samp("pnl")
    wide = rows.groupBy("series_id").pivot("training", list(TRAININGS)).agg((F.avg("pnl") / F.when(std > 0, std) * F.sqrt(F.lit(252.0 / STEPS))).alias("sharpe"), (100 * F.avg(F.col("hit").cast("double"))).alias("acc"))
    a, b, acc = F.col("expanding_sharpe"), F.col("rolling_sharpe"), F.col("rolling_acc")
    verdict = F.when((b >= a - 0.5) & (acc >= 50), "clean").when(a - b > 0.5, "risk").otherwise("weak")
    return wide.select("series_id", F.round(a, 4).alias("sharpe_expanding"), F.round(b, 4).alias("sharpe_rolling"), F.round(acc, 4).alias("accuracy_rolling"), verdict.alias("verdict"))


RIDGE = 1e-4  # times the number of rows, on every feature's own square


def _known_sql(terms, training, source):
    """Sums of ``terms`` over the rows known at each decision row of ``source``."""
    reach = "UNBOUNDED" if training == "expanding" else str(ROLLING + STEPS - 1)
    sums = ", ".join(f"coalesce(sum({t}) OVER p, 0) AS {name}" for name, t in terms.items())
    return f"SELECT * FROM (SELECT *, '{training}' AS training, {sums} FROM {source} WINDOW p AS (PARTITION BY series_id ORDER BY d ROWS BETWEEN {reach} PRECEDING AND {STEPS} PRECEDING)) WHERE i > {MIN_TRAIN} AND (i - 1) % {EVERY} = 0"


def _terms_sql(x, y, usable="true"):
    own = lambda v: f"CASE WHEN {usable} THEN CAST({v} AS DOUBLE) END"
    return {f"a_{i}_{j}": own(f"{x[i]} * {x[j]}") for i, j in L.pairs(len(x))} | {f"b_{i}": own(f"{v} * {y}") for i, v in enumerate(x)} | {"n": own("1")}


def _fitted_sql(x):
    return " + ".join(f"beta_{i} * {v}" for i, v in enumerate(x))


def _centred_sql(features):
    return ", ".join(f"{f} - first_value({f}) OVER (PARTITION BY series_id ORDER BY d) AS {f}_c" for f in features)


_X = ["1.0", *(f"{f}_c" for f in FEATURES)]


@query(
    "walkforward_ridge",
    f"""WITH {MATRIX_SQL}, cm AS (SELECT series_id, d, target, row_number() OVER (PARTITION BY series_id ORDER BY d) AS i, {_centred_sql(FEATURES)} FROM mx),
    ks AS ({' UNION ALL '.join(_known_sql(_terms_sql(_X, 'target'), t, 'cm') for t in TRAININGS)}), {L.elimination_sql('ks', 'sol', len(_X), RIDGE)},
    fv AS (SELECT *, {_fitted_sql(_X)} AS fit FROM sol) SELECT series_id, d, round(target, 6) AS actual, {', '.join(f"round(max(fit) FILTER (WHERE training = '{t}'), 6) AS {t}_forecast" for t in TRAININGS)} FROM fv GROUP BY series_id, d, target""",
)
def walkforward_ridge(spark, sf_dir):
    """Five-bar returns by ridge regression on all features, fitted anew at each decision row on expanding and on rolling rows known by then."""
    rows = matrix(spark, sf_dir).withColumn("i", F.row_number().over(S.ordered())).withColumns({f"{f}_c": L.centred(f) for f in FEATURES})
    x, y = [F.lit(1.0), *(F.col(f"{f}_c") for f in FEATURES)], F.col("target")
    fits = L.solved(trained(rows, L.normal_terms(x, y)), len(x), RIDGE).withColumn("fit", L.applied(x))
    wide = fits.groupBy("series_id", "d", "target").pivot("training", list(TRAININGS)).agg(F.first("fit"))
    return wide.select("series_id", "d", r6(y).alias("actual"), *(r6(F.col(t)).alias(f"{t}_forecast") for t in TRAININGS))


def implied_rows(spark, sf_dir) -> DataFrame:
    """Volatility rows with an implied volatility of their date; rows where that is missing or not positive are left out and ``i`` numbers the others."""
    day = F.dayofyear("d")
    implied = F.when(day % 13 == 0, None).when(day % 17 == 0, -1.0).otherwise(F.col("vol") / 1e5)
    rows = har_rows(spark, sf_dir).drop("i").join(panel(spark, sf_dir).select("d", implied.alias("implied")), "d", "left")
    return rows.where((S.finite(F.col("implied")) > 0)).withColumn("i", F.row_number().over(S.ordered()))


_LOGS = ("rv5", "rv22", "rv66", "implied")


def _log_rows(spark, sf_dir) -> DataFrame:
    rows = implied_rows(spark, sf_dir).withColumns({f"ln_{c}": F.ln(c) for c in _LOGS}).withColumn("y", F.ln("target"))
    return rows.withColumns({f"ln_{c}_c": L.centred(f"ln_{c}") for c in _LOGS})


_HX = ["1.0", *(f"ln_{c}_c" for c in _LOGS)]
IMPLIED_SQL = f"""{HAR_SQL}, {PANEL_SQL[PANEL_SQL.index("p0 AS") :]},
iv AS (SELECT h.series_id, h.d, h.rv5, h.rv22, h.rv66, h.target, CASE WHEN dayofyear(h.d) % 13 = 0 THEN NULL WHEN dayofyear(h.d) % 17 = 0 THEN -1.0 ELSE vol / 1e5 END AS implied FROM h LEFT JOIN p USING (d) WHERE rv66 IS NOT NULL),
u AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY d) AS i, ln(target) AS y, {', '.join(f'ln({c}) AS ln_{c}' for c in _LOGS)} FROM iv WHERE implied > 0 AND isfinite(implied)),
lv AS (SELECT *, {_centred_sql([f'ln_{c}' for c in _LOGS])} FROM u)"""


@query(
    "har_iv_multiregressor",
    f"""WITH {IMPLIED_SQL}, ks AS ({_known_sql(_terms_sql(_HX, 'y', 'target IS NOT NULL'), 'expanding', 'lv')}), {L.elimination_sql('ks', 'sol', len(_HX))}
    SELECT series_id, d, round(exp({_fitted_sql(_HX)}), 6) AS predicted, round(target, 6) AS actual, round(rv22, 6) AS rv_22, round(implied, 8) AS implied FROM sol WHERE target IS NOT NULL""",
)
def har_iv_multiregressor(spark, sf_dir):
    """Log-volatility on three horizons and the implied volatility by least squares, a fit for each decision row on all rows known by then."""
    x, ok = [F.lit(1.0), *(F.col(f"ln_{c}_c") for c in _LOGS)], F.col("target").isNotNull()
    rows = _log_rows(spark, sf_dir)
    rows = _decisions(rows.withColumns(L.known_sums(rows, L.normal_terms(x, F.col("y"), ok), STEPS, None))).where(ok)
    rows = L.solved(rows, len(x))
    return rows.select("series_id", "d", r6(F.exp(L.applied(x))).alias("predicted"), r6(F.col("target")).alias("actual"), r6(F.col("rv22")).alias("rv_22"), F.round("implied", 8).alias("implied"))


@query(
    "har_iv_live",
    f"""WITH {IMPLIED_SQL}, ks AS (SELECT series_id, max(d) AS d, {', '.join(f'arg_max({c}, d) AS {c}' for c in ('rv5', 'implied', *_HX[1:]))}, {', '.join(f'coalesce(sum({t}), 0) AS {name}' for name, t in _terms_sql(_HX, 'y', 'target IS NOT NULL').items())} FROM lv GROUP BY 1), {L.elimination_sql('ks', 'sol', len(_HX))},
    f AS (SELECT *, exp({_fitted_sql(_HX)}) AS forecast FROM sol)
    SELECT series_id, d AS as_of, CAST(n AS BIGINT) AS n_train, round(100 * rv5, 1) AS current_vol_pct, round(100 * forecast, 1) AS forecast_vol_pct, CASE WHEN forecast > rv5 THEN 'RISING' ELSE 'FALLING' END AS direction, round(100 * implied, 1) AS implied_pct FROM f""",
)
def har_iv_live(spark, sf_dir):
    """The forecast at the last row by a fit on all rows whose target is known, with realised volatility on three horizons and implied volatility."""
    x = [F.lit(1.0), *(F.col(f"ln_{c}_c") for c in _LOGS)]
    terms = L.normal_terms(x, F.col("y"), F.col("target").isNotNull())
    latest = [F.max_by(c, "d").alias(c) for c in ("rv5", "implied", *_HX[1:])]
    g = _log_rows(spark, sf_dir).groupBy("series_id").agg(F.max("d").alias("as_of"), *latest, *(F.coalesce(F.sum(t), F.lit(0.0)).alias(name) for name, t in terms.items()))
    g = L.solved(g, len(x)).withColumn("forecast", F.exp(L.applied(x)))
    fit, pct = F.col("forecast"), lambda v: F.round(100 * v, 1)
    return g.select("series_id", "as_of", F.col("n").cast("long").alias("n_train"), pct(F.col("rv5")).alias("current_vol_pct"), pct(fit).alias("forecast_vol_pct"), F.when(fit > F.col("rv5"), "RISING").otherwise("FALLING").alias("direction"), pct(F.col("implied")).alias("implied_pct"))


LEFT_OUT = 1995


@query(
    "har_summary_without_year",
    f"""WITH {HAR_SQL} SELECT series_id, count(*) AS n, round(100 * avg(CASE WHEN (predicted > rv22) = (target > rv22) THEN 1.0 ELSE 0.0 END), 4) AS direction_accuracy, round(avg(abs(predicted - target)), 6) AS mae_model,
    round(CASE WHEN var_pop(target) > 0 THEN 1 - sum((target - predicted) ** 2) / (var_pop(target) * count(*)) ELSE 0 END, 6) AS r2_model FROM fits WHERE year(d) <> {LEFT_OUT} GROUP BY 1""",
)
def har_summary_without_year(spark, sf_dir):
    """The volatility forecasts' figures without one exceptional year."""
    now, fit, y = F.col("rv22"), F.col("predicted"), F.col("target")
    return har_fits(spark, sf_dir).where(F.year("d") != LEFT_OUT).groupBy("series_id").agg(
        F.count("*").alias("n"), F.round(100 * F.avg(((fit > now) == (y > now)).cast("double")), 4).alias("direction_accuracy"), r6(F.avg(F.abs(fit - y))).alias("mae_model"), r6(T.r_squared(y, fit)).alias("r2_model")
    )


BINS = 8


@query(
    "feature_relevance_hybrid",
    f"""WITH {MATRIX_SQL}, lng AS (SELECT series_id, d, unnest([{', '.join(repr(f) for f in FEATURES)}]) AS feature, unnest([{', '.join(FEATURES)}]) AS v, target FROM mx),
    b AS (SELECT *, ntile({BINS}) OVER (PARTITION BY series_id, feature ORDER BY v, d) AS bx, ntile({BINS}) OVER (PARTITION BY series_id, feature ORDER BY target, d) AS yb FROM lng),
    c AS (SELECT series_id, feature, bx, yb, count(*) AS k FROM b GROUP BY 1, 2, 3, 4), m AS (SELECT *, sum(k) OVER (PARTITION BY series_id, feature, bx) AS kx, sum(k) OVER (PARTITION BY series_id, feature, yb) AS ky, sum(k) OVER (PARTITION BY series_id, feature) AS n FROM c),
    i AS (SELECT series_id, feature, greatest(0, sum(k / n * ln(k * n / (kx * ky)))) AS mi FROM m GROUP BY 1, 2), rr AS (SELECT series_id, feature, count(*) AS n, covar_samp(v, target) / nullif(stddev_samp(v) * stddev_samp(target), 0) AS rho FROM lng GROUP BY 1, 2),
    f AS (SELECT series_id, feature, coalesce(rho * rho / nullif(1 - rho * rho, 0) * (n - 2), 0) AS f_score FROM rr), j AS (SELECT *, (f_score / nullif(max(f_score) OVER s, 0) + mi / nullif(max(mi) OVER s, 0)) / 2 AS score, count(*) OVER s AS total FROM f JOIN i USING (series_id, feature) WINDOW s AS (PARTITION BY series_id)),
    k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(score, 9) DESC, feature) AS place, CASE WHEN least(24, greatest(6, round(0.65 * total))) < total THEN least(24, greatest(6, round(0.65 * total))) ELSE total - 1 END AS kept FROM j)
    SELECT series_id, feature, round(f_score, 4) AS f_score, round(mi, 6) AS mutual_information, round(score, 6) AS score, CAST(place AS INTEGER) AS place, place <= kept AS selected FROM k""",
)
def feature_relevance_hybrid(spark, sf_dir):
    """Linear (F score) and binned mutual-information relevance, each by its largest, averaged; the best are selected, a share of the features but one at least is left out.

    Mutual information is that of eight bins of equal counts on either side.
    """
    rows = matrix(spark, sf_dir).unpivot(["series_id", "d", "target"], list(FEATURES), "feature", "v")
    own = ["series_id", "feature"]
    by = lambda c: Window.partitionBy(*own).orderBy(c, "d")
    cells = rows.select(*own, F.ntile(BINS).over(by("v")).alias("bx"), F.ntile(BINS).over(by("target")).alias("yb")).groupBy(*own, "bx", "yb").agg(F.count("*").alias("k"))
    total = lambda *more: F.sum("k").over(Window.partitionBy(*own, *more))
    cells = cells.withColumns({"kx": total("bx"), "ky": total("yb"), "n": total()})
    k, n = F.col("k"), F.col("n")
    mi = cells.groupBy(*own).agg(F.greatest(F.lit(0.0), F.sum(k / n * F.ln(k * n / (F.col("kx") * F.col("ky"))))).alias("mi"))
    rho = F.try_divide(F.covar_samp("v", "target"), F.stddev_samp("v") * F.stddev_samp("target"))
    f = rows.groupBy(*own).agg(F.count("*").alias("n"), rho.alias("rho"))
    f = f.select(*own, F.coalesce(F.try_divide(F.col("rho") * F.col("rho"), 1 - F.col("rho") * F.col("rho")) * (F.col("n") - 2), F.lit(0.0)).alias("f_score"))
    whole = Window.partitionBy("series_id")
    share = lambda c: F.try_divide(F.col(c), F.max(c).over(whole))
    j = f.join(mi, own).withColumns({"score": (share("f_score") + share("mi")) / 2, "total": F.count("*").over(whole)})
    wanted = clip(F.round(0.65 * F.col("total")), 6.0, 24.0)
    kept = F.when(wanted < F.col("total"), wanted).otherwise(F.col("total") - 1)
    place = F.row_number().over(Window.partitionBy("series_id").orderBy(F.round("score", 9).desc(), "feature"))
    return j.select(*own, F.round("f_score", 4).alias("f_score"), r6(F.col("mi")).alias("mutual_information"), r6(F.col("score")).alias("score"), place.alias("place"), (place <= kept).alias("selected"))
