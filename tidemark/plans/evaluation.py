"""Walk-forward evaluation: purged fits, baselines, trades, metrics and tests."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import series as S
from ..functions import stats as T
from ..functions.series import past, r2, r6
from ..operators.asof import asof_join
from ..operators.bars import BARS_SQL, daily_bars, frames, numbered, table
from .registry import query

STEPS, MIN_TRAIN, EVERY = 5, 100, 5
COST, SIZE = 100.0, 10.0  # of a trade; units of a contract

HAR_SQL = f"""{BARS_SQL},
h AS (SELECT series_id, d, rn, CASE WHEN count(lr) OVER w5 = 5 THEN sqrt(avg(lr * lr) OVER w5 * 252) END AS rv5,
  CASE WHEN count(lr) OVER w22 = 22 THEN sqrt(avg(lr * lr) OVER w22 * 252) END AS rv22, CASE WHEN count(lr) OVER w66 = 66 THEN sqrt(avg(lr * lr) OVER w66 * 252) END AS rv66,
  CASE WHEN count(lr) OVER f5 = 5 THEN sqrt(avg(lr * lr) OVER f5 * 252) END AS target FROM r {frames(5, 22, 66)}, f5 AS (PARTITION BY series_id ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)),
x AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY d) AS i FROM h WHERE rv66 IS NOT NULL),
g AS (SELECT *, regr_slope(ln(target), ln(rv22)) OVER p AS slope, regr_intercept(ln(target), ln(rv22)) OVER p AS base, count(target) OVER p AS n_train FROM x
  WINDOW p AS (PARTITION BY series_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND {STEPS} PRECEDING)),
fits AS (SELECT series_id, d, rv5, rv22, target, n_train, exp(base + slope * ln(rv22)) AS predicted FROM g WHERE i > {MIN_TRAIN} AND (i - 1) % {EVERY} = 0 AND target IS NOT NULL)"""


def har_rows(spark, sf_dir):
    """Realised volatility over 5, 22 and 66 bars, and ``target``, that of the five bars to come; ``i`` numbers usable rows."""
    C = F.col("close")
    bars = daily_bars(spark, sf_dir).withColumn("lr", S.log_return(C))
    lr, ahead = F.col("lr"), S.ordered().rowsBetween(1, STEPS)
    rows = bars.select(
        "series_id", "d",
        *(F.sqrt(S.full(lr, F.avg(lr * lr), n) * 252).alias(f"rv{n}") for n in (5, 22, 66)),
        F.when(F.count(lr).over(ahead) == STEPS, F.sqrt(F.avg(lr * lr).over(ahead) * 252)).alias("target"),
    ).where("rv66 IS NOT NULL")
    return rows.withColumn("i", F.row_number().over(S.ordered()))


def har_fits(spark, sf_dir):
    """Forecasts of each decision row by a fit on rows whose target is known by then: the frame ends ``STEPS`` rows before."""
    rows, known = har_rows(spark, sf_dir), S.ordered().rowsBetween(Window.unboundedPreceding, -STEPS)
    x, y = F.ln("rv22"), F.ln("target")
    rows = rows.withColumns({"slope": F.regr_slope(y, x).over(known), "base": F.regr_intercept(y, x).over(known), "n_train": F.count("target").over(known)})
    decisions = rows.where((F.col("i") > MIN_TRAIN) & ((F.col("i") - 1) % EVERY == 0) & F.col("target").isNotNull())
    return decisions.select("series_id", "d", "rv5", "rv22", "target", "n_train", F.exp(F.col("base") + F.col("slope") * x).alias("predicted"))


@query(
    "purged_har_walkforward",
    f"""WITH {HAR_SQL} SELECT series_id, d, n_train, round(rv22, 6) AS rv_22, round(predicted, 6) AS predicted, round(target, 6) AS actual,
    (predicted > rv22) = (target > rv22) AS direction_hit FROM fits""",
)
def purged_har_walkforward(spark, sf_dir):
    fits = har_fits(spark, sf_dir)
    hit = (F.col("predicted") > F.col("rv22")) == (F.col("target") > F.col("rv22"))
    return fits.select("series_id", "d", "n_train", r6(F.col("rv22")).alias("rv_22"), r6(F.col("predicted")).alias("predicted"), r6(F.col("target")).alias("actual"), hit.alias("direction_hit"))


@query(
    "har_summary_by_year",
    f"""WITH {HAR_SQL} SELECT series_id, CAST(year(d) AS INTEGER) AS year, count(*) AS n, round(100 * avg(CASE WHEN (predicted > rv22) = (target > rv22) THEN 1.0 ELSE 0.0 END), 4) AS direction_accuracy,
    round(100 * greatest(avg(CASE WHEN target > rv22 THEN 1.0 ELSE 0.0 END), 1 - avg(CASE WHEN target > rv22 THEN 1.0 ELSE 0.0 END)), 4) AS majority_accuracy,
    round(avg(abs(predicted - target)), 6) AS mae_model, round(avg(abs(rv22 - target)), 6) AS mae_persistence,
    round(CASE WHEN var_pop(target) > 0 THEN 1 - sum((target - predicted) ** 2) / (var_pop(target) * count(*)) ELSE 0 END, 6) AS r2_model FROM fits GROUP BY 1, 2""",
)
def har_summary_by_year(spark, sf_dir):
    fits = har_fits(spark, sf_dir)
    now, fit, y = F.col("rv22"), F.col("predicted"), F.col("target")
    up = F.avg((y > now).cast("double"))
    return fits.groupBy("series_id", F.year("d").alias("year")).agg(
        F.count("*").alias("n"),
        F.round(100 * F.avg(((fit > now) == (y > now)).cast("double")), 4).alias("direction_accuracy"),
        F.round(100 * F.greatest(up, 1 - up), 4).alias("majority_accuracy"),
        r6(F.avg(F.abs(fit - y))).alias("mae_model"), r6(F.avg(F.abs(now - y))).alias("mae_persistence"), r6(T.r_squared(y, fit)).alias("r2_model"),
    )


WALK_SQL = f"""{BARS_SQL},
b AS (SELECT series_id, d, rn, close, lead(close, {STEPS}) OVER o AS actual, close AS naive, close + {STEPS} * avg(close - pc) OVER before AS drift, lag(close, 5) OVER o AS price_5d_ago,
  close + {STEPS} * avg(close - pc) OVER w20 AS challenger FROM n {frames(20)}, before AS (PARTITION BY series_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
walk AS (SELECT * FROM b WHERE rn > {MIN_TRAIN} AND (rn - 1) % {EVERY} = 0 AND actual IS NOT NULL),
models AS (SELECT series_id, d, close, actual, unnest(['naive', 'drift', 'price_5d_ago', 'challenger']) AS model, unnest([naive, drift, price_5d_ago, challenger]) AS pred FROM walk)"""
MODELS = ("naive", "drift", "price_5d_ago", "challenger")


def walk(spark, sf_dir):
    """Decision rows with the price ``STEPS`` bars on and the forecasts of four simple models on observed prices."""
    C = F.col("close")
    bars = numbered(daily_bars(spark, sf_dir)).withColumn("diff", C - S.lagged(C, 1))
    before = S.ordered().rowsBetween(Window.unboundedPreceding, -1)
    rows = bars.select(
        "series_id", "d", "rn", "close", F.lead(C, STEPS).over(S.ordered()).alias("actual"), C.alias("naive"), (C + STEPS * F.avg("diff").over(before)).alias("drift"),
        S.lagged(C, 5).alias("price_5d_ago"), (C + STEPS * F.avg("diff").over(past(20))).alias("challenger"),
    )
    return rows.where((F.col("rn") > MIN_TRAIN) & ((F.col("rn") - 1) % EVERY == 0) & F.col("actual").isNotNull())


def by_model(spark, sf_dir):
    return walk(spark, sf_dir).unpivot(["series_id", "d", "close", "actual"], list(MODELS), "model", "pred")


@query("walkforward_baselines", f"""WITH {WALK_SQL} SELECT series_id, d, close, actual, naive, round(drift, 3) AS drift, price_5d_ago, round(challenger, 4) AS challenger FROM walk""")
def walkforward_baselines(spark, sf_dir):
    return walk(spark, sf_dir).select("series_id", "d", "close", "actual", "naive", F.round("drift", 3).alias("drift"), "price_5d_ago", F.round("challenger", 4).alias("challenger"))


METRICS_SQL = f"""{WALK_SQL},
m AS (SELECT series_id, model, count(*) AS n, avg(abs(actual - pred)) AS mae, sqrt(avg((actual - pred) ** 2)) AS rmse, 100 * avg(abs(actual - pred) / greatest(abs(actual), 1e-6)) AS mape,
  CAST(sum(CASE WHEN sign(pred - close) = sign(actual - close) THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM models GROUP BY 1, 2)"""


def metrics(spark, sf_dir):
    """Error metrics of each model; a direction is right if the signs are equal, zero included."""
    C = F.col("close")
    y, p = F.col("actual"), F.col("pred")
    return by_model(spark, sf_dir).groupBy("series_id", "model").agg(
        F.count("*").alias("n"), F.avg(F.abs(y - p)).alias("mae"), F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"),
        (100 * F.avg(F.abs(y - p) / F.greatest(F.abs(y), F.lit(1e-6)))).alias("mape"), F.count_if(S.sign(p - C) == S.sign(y - C)).alias("hits"),
    )


@query(
    "direction_metrics_wilson",
    f"""WITH {METRICS_SQL}, p AS (SELECT *, hits / n AS p, 1.96 ** 2 AS z2 FROM m) SELECT series_id, model, n, round(mae, 2) AS mae, round(rmse, 2) AS rmse, round(mape, 6) AS mape, hits, round(100 * p, 4) AS direction_accuracy,
    round(greatest(0, 100 * (p + z2 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)), 4) AS wilson_low,
    round(least(100, 100 * (p + z2 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)), 4) AS wilson_high FROM p""",
)
def direction_metrics_wilson(spark, sf_dir):
    m = metrics(spark, sf_dir)
    low, high = T.wilson(F.col("hits"), F.col("n"))
    return m.select(
        "series_id", "model", "n", r2(F.col("mae")).alias("mae"), r2(F.col("rmse")).alias("rmse"), r6(F.col("mape")).alias("mape"), "hits",
        F.round(100 * F.col("hits") / F.col("n"), 4).alias("direction_accuracy"), F.round(low, 4).alias("wilson_low"), F.round(high, 4).alias("wilson_high"),
    )


@query(
    "binomial_pvalue",
    f"""WITH {METRICS_SQL}, t AS (SELECT series_id, model, n, hits, unnest(generate_series(hits, n)) AS j FROM m),
    s AS (SELECT series_id, model, sum(exp(lgamma(n + 1.0) - lgamma(j + 1.0) - lgamma(n - j + 1.0) + n * ln(0.5))) AS p FROM t GROUP BY 1, 2)
    SELECT series_id, model, n, hits, round(CASE WHEN hits <= 0 THEN 1.0 ELSE p END, 6) AS p_value, hits > 0 AND p < 0.05 AS is_significant FROM m JOIN s USING (series_id, model)""",
)
def binomial_pvalue(spark, sf_dir):
    m = metrics(spark, sf_dir).withColumn("p", T.binomial_tail(F.col("hits").cast("double"), F.col("n").cast("double"), F.lit(0.5)))
    return m.select("series_id", "model", "n", "hits", r6(F.col("p")).alias("p_value"), (F.col("p") < 0.05).alias("is_significant"))


@query(
    "best_baseline",
    f"""WITH {METRICS_SQL}, k AS (SELECT *, CASE model WHEN 'naive' THEN 0 WHEN 'drift' THEN 1 ELSE 2 END AS o FROM m),
    bb AS (SELECT series_id, arg_min(model, row(mae, o)) AS best, min(mae) AS best_mae FROM k WHERE model <> 'challenger' GROUP BY 1)
    SELECT bb.series_id, best, round(best_mae, 2) AS best_mae, round(100 * (best_mae - m.mae) / nullif(best_mae, 0), 6) AS improvement_pct FROM bb JOIN m ON m.series_id = bb.series_id AND m.model = 'challenger'""",
)
def best_baseline(spark, sf_dir):
    """The baseline with the least error (earlier in the list on ties) and how much the challenger improves on it."""
    order = F.when(F.col("model") == "naive", 0).when(F.col("model") == "drift", 1).otherwise(2)
    base = F.col("model") != "challenger"
    m = metrics(spark, sf_dir).groupBy("series_id").agg(
        F.min_by(F.when(base, F.col("model")), F.when(base, F.struct("mae", order))).alias("best"), F.min(F.when(base, F.col("mae"))).alias("least"), F.max(F.when(~base, F.col("mae"))).alias("own")
    )
    return m.select("series_id", "best", r2(F.col("least")).alias("best_mae"), r6(F.try_divide(100 * (F.col("least") - F.col("own")), F.col("least"))).alias("improvement_pct"))


TRADES_SQL = f"""{WALK_SQL},
trades AS (SELECT series_id, d, CAST(sign(challenger - close) AS INTEGER) AS dir, round(sign(challenger - close) * (actual - close) * {SIZE} - {COST}, 2) AS pnl,
  row_number() OVER (PARTITION BY series_id ORDER BY d) AS trade FROM walk WHERE sign(challenger - close) <> 0),
equity AS (SELECT *, sum(pnl) OVER (PARTITION BY series_id ORDER BY d ROWS UNBOUNDED PRECEDING) AS total FROM trades),
peaks AS (SELECT *, max(total) OVER (PARTITION BY series_id ORDER BY d ROWS UNBOUNDED PRECEDING) AS peak FROM equity)"""


def trades(spark, sf_dir):
    """A trade for each decision row on the challenger's side, net of cost; none where it sees no change."""
    C = F.col("close")
    side = S.sign(F.col("challenger") - C)
    rows = walk(spark, sf_dir).withColumn("dir", side).where("dir <> 0")
    rows = rows.select("series_id", "d", "dir", F.round(F.col("dir") * (F.col("actual") - C) * SIZE - COST, 2).alias("pnl"))
    return rows.withColumn("trade", F.row_number().over(S.ordered()).cast("long"))


@query("trade_ledger", f"WITH {TRADES_SQL} SELECT series_id, trade, d, dir, pnl FROM trades")
def trade_ledger(spark, sf_dir):
    return trades(spark, sf_dir).select("series_id", "trade", "d", "dir", "pnl")


def equity(spark, sf_dir):
    rows = trades(spark, sf_dir).withColumn("total", F.sum("pnl").over(past()))
    return rows.withColumn("peak", F.max("total").over(past()))


@query("equity_drawdown", f"WITH {TRADES_SQL} SELECT series_id, trade, d, round(total, 2) AS equity, round(peak - total, 2) AS drawdown FROM peaks")
def equity_drawdown(spark, sf_dir):
    return equity(spark, sf_dir).select("series_id", "trade", "d", r2(F.col("total")).alias("equity"), r2(F.col("peak") - F.col("total")).alias("drawdown"))


PNL_SQL = f"""{TRADES_SQL},
p AS (SELECT series_id, count(*) AS n, sum(pnl) AS total_pnl, avg(pnl) AS mean_pnl, stddev_samp(pnl) AS std_pnl, 100 * avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, max(peak - total) AS max_drawdown,
  coalesce(sum(pnl) FILTER (WHERE pnl > 0), 0) AS gains, -coalesce(sum(pnl) FILTER (WHERE pnl < 0), 0) AS losses, -avg(pnl) FILTER (WHERE pnl < 0) AS mean_loss FROM peaks GROUP BY 1)"""


def pnl(spark, sf_dir):
    """Totals of the trades of each series; the drawdown's peak starts at the first trade's equity."""
    x = F.col("pnl")
    return equity(spark, sf_dir).groupBy("series_id").agg(
        F.count("*").alias("n"), F.sum(x).alias("total_pnl"), F.avg(x).alias("mean_pnl"), F.stddev_samp(x).alias("std_pnl"), (100 * F.avg((x > 0).cast("double"))).alias("win_rate"),
        F.max(F.col("peak") - F.col("total")).alias("max_drawdown"), F.coalesce(F.sum(F.when(x > 0, x)), F.lit(0.0)).alias("gains"),
        (-F.coalesce(F.sum(F.when(x < 0, x)), F.lit(0.0))).alias("losses"), (-F.avg(F.when(x < 0, x))).alias("mean_loss"),
    )


@query(
    "pnl_metrics",
    f"""WITH {PNL_SQL} SELECT series_id, n, round(total_pnl, 2) AS total_pnl, round(mean_pnl, 2) AS mean_pnl, round(std_pnl, 2) AS std_pnl, round(mean_pnl / nullif(std_pnl, 0) * sqrt(252.0 / {STEPS}), 6) AS sharpe,
    round(win_rate, 4) AS win_rate, round(max_drawdown, 2) AS max_drawdown, round(gains / nullif(losses, 0), 6) AS profit_factor FROM p""",
)
def pnl_metrics(spark, sf_dir):
    c = F.col
    return pnl(spark, sf_dir).select(
        "series_id", "n", r2(c("total_pnl")).alias("total_pnl"), r2(c("mean_pnl")).alias("mean_pnl"), r2(c("std_pnl")).alias("std_pnl"),
        r6(c("mean_pnl") / F.when(c("std_pnl") > 0, c("std_pnl")) * F.sqrt(F.lit(252.0 / STEPS))).alias("sharpe"), F.round("win_rate", 4).alias("win_rate"),
        r2(c("max_drawdown")).alias("max_drawdown"), r6(c("gains") / F.when(c("losses") > 0, c("losses"))).alias("profit_factor"),
    )


@query(
    "pnl_by_year",
    f"""WITH {TRADES_SQL} SELECT series_id, CAST(year(d) AS INTEGER) AS year, count(*) AS n, round(sum(pnl), 2) AS total_pnl, round(avg(pnl) / nullif(stddev_samp(pnl), 0) * sqrt(252.0 / {STEPS}), 6) AS sharpe,
    round(100 * avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END), 4) AS win_rate FROM trades GROUP BY 1, 2""",
)
def pnl_by_year(spark, sf_dir):
    std = F.stddev_samp("pnl")
    return trades(spark, sf_dir).groupBy("series_id", F.year("d").alias("year")).agg(
        F.count("*").alias("n"), r2(F.sum("pnl")).alias("total_pnl"), r6(F.avg("pnl") / F.when(std > 0, std) * F.sqrt(F.lit(252.0 / STEPS))).alias("sharpe"),
        F.round(100 * F.avg((F.col("pnl") > 0).cast("double")), 4).alias("win_rate"),
    )


@query(
    "kelly_sizing",
    f"""WITH {PNL_SQL}, k AS (SELECT series_id, win_rate / 100 AS p, gains / nullif(losses, 0) AS pf, mean_loss FROM p), kb AS (SELECT *, pf * (1 - p) / nullif(p, 0) AS b FROM k)
    SELECT series_id, round(b, 6) AS payoff, round(p - (1 - p) / nullif(b, 0), 6) AS kelly_fraction, round(mean_loss, 2) AS mean_loss, CAST(ceil(mean_loss / 0.02 / 5000) * 5000 AS BIGINT) AS account_per_contract FROM kb""",
)
def kelly_sizing(spark, sf_dir):
    """Kelly fraction from win rate and profit factor, and an account that risks 2 % on a mean loss, in steps of 5,000."""
    p = F.col("win_rate") / 100
    payoff = F.col("gains") / F.when(F.col("losses") > 0, F.col("losses")) * (1 - p) / F.when(p > 0, p)
    return pnl(spark, sf_dir).select(
        "series_id", r6(payoff).alias("payoff"), r6(p - (1 - p) / F.when(payoff != 0, payoff)).alias("kelly_fraction"), r2(F.col("mean_loss")).alias("mean_loss"),
        (F.ceil(F.col("mean_loss") / 0.02 / 5000) * 5000).cast("long").alias("account_per_contract"),
    )


LAGS, BARTLETT = 10, 5


@query(
    "autocorr_ess",
    f"""WITH {TRADES_SQL}, hit AS (SELECT series_id, trade, CASE WHEN pnl > -{COST} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS h FROM trades),
    c AS (SELECT series_id, trade, h, h - avg(h) OVER (PARTITION BY series_id) AS x, count(*) OVER (PARTITION BY series_id) AS n FROM hit),
    l AS (SELECT a.series_id, k.lag, sum(a.x * b.x) AS cov FROM c a, (SELECT unnest(generate_series(1, {LAGS})) AS lag) k JOIN c b ON true WHERE b.series_id = a.series_id AND b.trade = a.trade - k.lag GROUP BY 1, 2),
    v AS (SELECT series_id, sum(x * x) AS var, any_value(n) AS n, avg(h) AS p FROM c GROUP BY 1),
    s AS (SELECT v.series_id, n, p, 1 + 2 * sum(CASE WHEN lag <= {BARTLETT} THEN (1 - lag / {BARTLETT + 1}.0) * cov / nullif(var, 0) ELSE 0 END) AS factor FROM v JOIN l USING (series_id) GROUP BY 1, 2, 3),
    e AS (SELECT *, CASE WHEN factor <= 0 THEN n ELSE least(n, n / factor) END AS ess FROM s)
    SELECT l.series_id, CAST(lag AS INTEGER) AS lag, round(cov / nullif(var, 0), 6) AS acf, round(ess, 4) AS ess, round((e.p - 0.5) / sqrt(0.25 / ess), 6) AS z_at_ess FROM l JOIN v USING (series_id) JOIN e ON e.series_id = l.series_id""",
)
def autocorr_ess(spark, sf_dir):
    """Autocorrelation of hits at lags 1 to 10 (global mean, full denominator) and the effective sample size by Bartlett weights."""
    whole = Window.partitionBy("series_id")
    hits = trades(spark, sf_dir).withColumn("h", (F.col("pnl") > -COST).cast("double"))
    x = hits.withColumns({"x": F.col("h") - F.avg("h").over(whole)})
    order = Window.partitionBy("series_id").orderBy("trade")
    products = [F.sum(F.col("x") * F.col(f"x{k}")).alias(f"c{k}") for k in range(1, LAGS + 1)]
    sums = x.withColumns({f"x{k}": F.lag("x", k).over(order) for k in range(1, LAGS + 1)}).groupBy("series_id")
    sums = sums.agg(F.sum(F.col("x") * F.col("x")).alias("var"), F.count("*").alias("n"), F.avg("h").alias("p"), *products)
    var = F.when(F.col("var") > 0, F.col("var"))
    factor = 1 + 2 * sum(((1 - k / (BARTLETT + 1)) * F.col(f"c{k}") / var for k in range(1, BARTLETT + 1)), F.lit(0.0))
    sums = sums.withColumn("factor", factor).withColumn("ess", F.when(F.col("factor") <= 0, F.col("n").cast("double")).otherwise(F.least(F.col("n").cast("double"), F.col("n") / F.when(F.col("factor") > 0, F.col("factor")))))
    lags = sums.select("series_id", "p", "ess", F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), (F.col(f"c{k}") / var).alias("acf")) for k in range(1, LAGS + 1)))).alias("l"))
    lags = lags.where("l.acf IS NOT NULL")
    return lags.select("series_id", "l.lag", r6(F.col("l.acf")).alias("acf"), F.round("ess", 4).alias("ess"), r6((F.col("p") - 0.5) / F.sqrt(0.25 / F.col("ess"))).alias("z_at_ess"))


HORIZONS = {"1h": (1, 6), "1d": (24, 72), "1w": (168, 240)}
LEDGER_SQL = """hz AS (SELECT * FROM (VALUES ('1h', 1, 6), ('1d', 24, 72), ('1w', 168, 240)) t(horizon, delta, win)),
f AS (SELECT event_id, user_id, horizon, win, ts AS issued_at, value AS price, value * (1 + 0.01 * ((event_id % 7) - 3)) AS pred, value * 0.9 AS low, value * 1.1 AS high, ts + to_hours(delta) AS target
  FROM events, hz WHERE event_type = 'view'),
a AS (SELECT user_id, ts AS actual_at, max(value) AS actual FROM events WHERE event_type = 'click' GROUP BY 1, 2),
led AS (SELECT f.*, CASE WHEN actual_at <= target + to_hours(win) THEN actual END AS actual FROM f ASOF LEFT JOIN a ON f.user_id = a.user_id AND f.target <= a.actual_at)"""


def ledger(spark, sf_dir):
    """Forecasts of three horizons from each ``view`` event with the first ``click`` price in the horizon's window after its target."""
    events = table(spark, sf_dir, "events")
    spans = F.array(*(F.struct(F.lit(h).alias("horizon"), F.lit(d).alias("delta"), F.lit(w).alias("win")) for h, (d, w) in HORIZONS.items()))
    rows = events.where("event_type = 'view'").select("event_id", "user_id", F.col("ts").alias("issued_at"), F.col("value").alias("price"), F.explode(spans).alias("s"))
    p = F.col("price")
    rows = rows.select(
        "event_id", "user_id", "issued_at", "price", "s.horizon", "s.win", (p * (1 + 0.01 * (F.col("event_id") % 7 - 3))).alias("pred"), (p * 0.9).alias("low"), (p * 1.1).alias("high"),
        (F.col("issued_at") + F.make_dt_interval(hours=F.col("s.delta"))).alias("target"),
    )
    actuals = events.where("event_type = 'click'").groupBy("user_id", F.col("ts").alias("actual_at")).agg(F.max("value").alias("actual"))
    return asof_join(rows, actuals, ["user_id"], "target", "actual_at", ["actual"], "forward", F.col("actual_at") <= F.col("target") + F.make_dt_interval(hours=F.col("win")))


@query(
    "horizon_accuracy_rollup",
    f"""WITH {LEDGER_SQL} SELECT coalesce(horizon, 'overall') AS horizon, count(*) AS n, round(100 * avg(CASE WHEN sign(pred - price) = sign(actual - price) THEN 1.0 ELSE 0.0 END), 4) AS direction_accuracy, round(avg(abs(actual - pred)), 6) AS mae,
    round(sqrt(avg((actual - pred) ** 2)), 6) AS rmse, round(100 * avg(abs(actual - pred) / greatest(abs(actual), 1e-6)), 4) AS mape, CAST(sum(CASE WHEN actual BETWEEN low AND high THEN 1 ELSE 0 END) AS BIGINT) AS interval_hits,
    round(100 * avg(CASE WHEN actual BETWEEN low AND high THEN 1.0 ELSE 0.0 END), 4) AS interval_coverage,
    round(avg(sign(pred - price) * (actual - price) / nullif(price, 0)) / nullif(stddev_pop(sign(pred - price) * (actual - price) / nullif(price, 0)), 0), 6) AS sharpe_like FROM led WHERE actual IS NOT NULL GROUP BY ROLLUP (horizon)""",
)
def horizon_accuracy_rollup(spark, sf_dir):
    """Accuracy by horizon and overall; the overall row weighs every resolved forecast alike."""
    y, p, c = F.col("actual"), F.col("pred"), F.col("price")
    inside, gain = y.between(F.col("low"), F.col("high")), F.try_divide(S.sign(p - c) * (y - c), c)
    spread = F.stddev_pop(gain)
    rows = ledger(spark, sf_dir).where("actual IS NOT NULL").rollup("horizon").agg(
        F.count("*").alias("n"), F.round(100 * F.avg((S.sign(p - c) == S.sign(y - c)).cast("double")), 4).alias("direction_accuracy"), r6(F.avg(F.abs(y - p))).alias("mae"),
        r6(F.sqrt(F.avg((y - p) * (y - p)))).alias("rmse"), F.round(100 * F.avg(F.abs(y - p) / F.greatest(F.abs(y), F.lit(1e-6))), 4).alias("mape"), F.count_if(inside).alias("interval_hits"),
        F.round(100 * F.avg(inside.cast("double")), 4).alias("interval_coverage"), r6(F.avg(gain) / F.when(spread > 0, spread)).alias("sharpe_like"),
    )
    return rows.withColumn("horizon", F.coalesce("horizon", F.lit("overall")))


def drift_sql(*features):
    """Mean absolute z-score of a group's newest forecast, each clipped at eight, by features."""
    z = [f"abs(least(8, greatest(-8, (arg_max({f}, row(issued_at, event_id)) - avg({f})) / nullif(stddev_samp({f}), 0))))" for f in features]
    return f"coalesce(({' + '.join(f'coalesce({v}, 0)' for v in z)}) / nullif({' + '.join(f'CAST({v} IS NOT NULL AS INTEGER)' for v in z)}, 0), 0)"


def drift_of(*features):
    """The same as an aggregate; 0 where no feature varies."""
    z = []
    for f in features:
        std = F.stddev_samp(f)
        z.append(F.abs(S.clip((F.max_by(f, F.struct("issued_at", "event_id")) - F.avg(f)) / F.when(std > 0, std), -8.0, 8.0)))
    n = sum((v.isNotNull().cast("int") for v in z[1:]), z[0].isNotNull().cast("int"))
    return F.when(n > 0, sum((F.coalesce(v, F.lit(0.0)) for v in z[1:]), F.coalesce(z[0], F.lit(0.0))) / F.when(n > 0, n)).otherwise(0.0)


NEWEST, QUANTILE, COVERAGE, GAIN = 80, 0.80, 0.80, 0.25  # errors that count, the quantile's level, the coverage wanted, how fast margins follow it
_LEVEL_SQL = f"CASE WHEN covered > 0 THEN least(0.98, greatest(0.65, {QUANTILE} + 0.2 * ({COVERAGE} - covered))) ELSE {QUANTILE} END"


def interpolated(values, level):
    """The value of an ordered array at ``level`` between its first (0) and its last (1)."""
    place = level * (F.size(values) - 1)
    low = F.floor(place).cast("int")
    a, b = F.get(values, low), F.get(values, F.least(low + 1, F.size(values) - 1))
    return a + (b - a) * (place - low)


@query(
    "interval_calibration",
    f"""WITH {LEDGER_SQL}, e AS (SELECT horizon, abs(actual - pred) AS err, price, row_number() OVER (PARTITION BY horizon ORDER BY issued_at DESC, event_id DESC) AS k FROM led WHERE actual IS NOT NULL),
    w AS (SELECT horizon, count(*) AS n, avg(price) AS price, stddev_pop(err) AS std, list_sort(list(err)) AS errs FROM e WHERE k <= {NEWEST} GROUP BY 1),
    t AS (SELECT horizon, count(*) AS total, avg(abs(actual - pred)) AS mae, sqrt(avg((actual - pred) ** 2)) AS rmse, avg(CASE WHEN actual BETWEEN low AND high THEN 1.0 ELSE 0.0 END) AS covered, {drift_sql('price', 'move')} AS drift_score FROM (SELECT *, pred - price AS move FROM led WHERE actual IS NOT NULL) GROUP BY 1),
    l AS (SELECT *, {_LEVEL_SQL} AS level FROM t JOIN w USING (horizon)), p AS (SELECT *, level * (n - 1) AS place, CAST(floor(level * (n - 1)) AS BIGINT) AS lo FROM l),
    q AS (SELECT *, errs[lo + 1] + (errs[least(lo + 2, n)] - errs[lo + 1]) * (place - lo) AS q, greatest(0.05, 0.0015 * price) AS floor_margin FROM p),
    m AS (SELECT *, greatest(floor_margin, 1.64 * std, 1.1 * mae, 0.9 * rmse, CASE WHEN n >= 8 THEN q ELSE 0 END) AS base FROM q)
    SELECT horizon, total, n, round(mae, 6) AS mae, round(100 * covered, 4) AS coverage_pct, round(level, 6) AS quantile_level, round(q, 6) AS error_quantile, round(drift_score, 6) AS drift_score, round(base, 6) AS base_margin,
    round(greatest(floor_margin, base * (1 + least(0.35, 0.1 * greatest(0, drift_score - 1.5))) * CASE WHEN covered > 0 THEN 1 + least(0.35, greatest(-0.18, {GAIN} * ({COVERAGE} - covered))) ELSE 1 END), 6) AS margin FROM m""",
)
def interval_calibration(spark, sf_dir):
    """Interval margin of each horizon: the widest of floor, dispersion, error metrics and a quantile of the newest errors, corrected by drift and coverage.

    The quantile's level moves with the coverage that past intervals had, so intervals that covered too little widen twice: by the level and by a factor.
    """
    y, p = F.col("actual"), F.col("pred")
    rows = ledger(spark, sf_dir).where("actual IS NOT NULL").withColumns({"err": F.abs(y - p), "move": p - F.col("price")})
    newest = Window.partitionBy("horizon").orderBy(F.desc("issued_at"), F.desc("event_id"))
    late = rows.withColumn("k", F.row_number().over(newest)).where(F.col("k") <= NEWEST).groupBy("horizon").agg(F.count("*").alias("n"), F.avg("price").alias("price"), F.stddev_pop("err").alias("std"), F.sort_array(F.collect_list("err")).alias("errs"))
    whole = rows.groupBy("horizon").agg(
        F.count("*").alias("total"), F.avg("err").alias("mae"), F.sqrt(F.avg(F.col("err") * F.col("err"))).alias("rmse"), F.avg(y.between(F.col("low"), F.col("high")).cast("double")).alias("covered"), drift_of("price", "move").alias("drift_score")
    )
    gap, told = COVERAGE - F.col("covered"), F.col("covered") > 0
    g = whole.join(late, "horizon").withColumn("level", F.when(told, S.clip(QUANTILE + 0.2 * gap, 0.65, 0.98)).otherwise(QUANTILE))
    g = g.withColumns({"q": interpolated(F.col("errs"), F.col("level")), "floor_margin": F.greatest(F.lit(0.05), 0.0015 * F.col("price"))})
    base = F.greatest(F.col("floor_margin"), 1.64 * F.col("std"), 1.1 * F.col("mae"), 0.9 * F.col("rmse"), F.when(F.col("n") >= 8, F.col("q")).otherwise(0.0))
    adrift = 1 + F.least(F.lit(0.35), 0.1 * F.greatest(F.lit(0.0), F.col("drift_score") - 1.5))
    margin = F.greatest(F.col("floor_margin"), base * adrift * F.when(told, 1 + S.clip(GAIN * gap, -0.18, 0.35)).otherwise(1.0))
    return g.select(
        "horizon", "total", "n", r6(F.col("mae")).alias("mae"), F.round(100 * F.col("covered"), 4).alias("coverage_pct"), r6(F.col("level")).alias("quantile_level"), r6(F.col("q")).alias("error_quantile"), r6(F.col("drift_score")).alias("drift_score"), r6(base).alias("base_margin"), r6(margin).alias("margin")
    )


CARRY_H, CARRY_MIN = 21, 100
CARRY_SQL = f"""legs AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS m, CAST(l_shipdate AS DATE) AS d, avg(l_extendedprice / l_quantity) FILTER (WHERE l_returnflag = 'N') AS c1,
  avg(l_extendedprice / l_quantity) FILTER (WHERE l_returnflag <> 'N') AS c2 FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2),
cv AS (SELECT 'all' AS series_id, d, c1, (c1 - c2) / c2 AS carry, row_number() OVER (ORDER BY d) AS i, lead(c1, {CARRY_H}) OVER (ORDER BY d) / c1 - 1 AS fwd FROM legs WHERE c1 > 0 AND c2 > 0),
th AS (SELECT *, quantile_cont(carry, 0.5) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND {CARRY_H} PRECEDING) AS threshold FROM cv),
dec AS (SELECT *, carry > threshold AS long FROM th WHERE i > {CARRY_MIN} AND (i - 1) % 5 = 0 AND fwd IS NOT NULL)"""


def carry_decisions(spark, sf_dir):
    """Term-structure carry with its purged expanding median; one row a calendar day, however many line items there are."""
    rows = table(spark, sf_dir, "lineitem").where("l_quantity > 0").withColumn("unit", F.col("l_extendedprice") / F.col("l_quantity"))
    front = F.col("l_returnflag") == "N"
    legs = rows.groupBy(F.lit("all").alias("series_id"), F.col("l_shipdate").cast("date").alias("d")).agg(F.avg(F.when(front, F.col("unit"))).alias("c1"), F.avg(F.when(~front, F.col("unit"))).alias("c2"))
    legs = legs.where("c1 > 0 AND c2 > 0").withColumn("carry", (F.col("c1") - F.col("c2")) / F.col("c2"))
    legs = legs.withColumns({"i": F.row_number().over(S.ordered()), "fwd": F.lead("c1", CARRY_H).over(S.ordered()) / F.col("c1") - 1})
    legs = legs.withColumn("threshold", F.percentile("carry", 0.5).over(S.ordered().rowsBetween(Window.unboundedPreceding, -CARRY_H)))
    return legs.where((F.col("i") > CARRY_MIN) & ((F.col("i") - 1) % 5 == 0) & F.col("fwd").isNotNull()).withColumn("long", F.col("carry") > F.col("threshold"))


@query(
    "carry_timing",
    f"""WITH {CARRY_SQL} SELECT count(*) AS n, round(avg(CASE WHEN long = (fwd > 0) THEN 1.0 ELSE 0.0 END), 6) AS direction_accuracy, round(greatest(avg(CASE WHEN fwd > 0 THEN 1.0 ELSE 0.0 END), 1 - avg(CASE WHEN fwd > 0 THEN 1.0 ELSE 0.0 END)), 6) AS base_rate,
    round(avg(CASE WHEN long THEN fwd ELSE 0 END) / nullif(stddev_pop(CASE WHEN long THEN fwd ELSE 0 END), 0) * sqrt(252.0 / {CARRY_H}), 6) AS timed_sharpe, round(avg(fwd) / nullif(stddev_pop(fwd), 0) * sqrt(252.0 / {CARRY_H}), 6) AS hold_sharpe,
    round(avg(fwd) FILTER (WHERE long), 6) AS mean_backwardated, round(avg(fwd) FILTER (WHERE NOT long), 6) AS mean_contango FROM dec""",
)
def carry_timing(spark, sf_dir):
    fwd, long = F.col("fwd"), F.col("long")
    timed, up, root = F.when(long, fwd).otherwise(0.0), F.avg((fwd > 0).cast("double")), F.sqrt(F.lit(252.0 / CARRY_H))
    safe = lambda x: F.when(x > 0, x)
    return carry_decisions(spark, sf_dir).agg(
        F.count("*").alias("n"), r6(F.avg((long == (fwd > 0)).cast("double"))).alias("direction_accuracy"), r6(F.greatest(up, 1 - up)).alias("base_rate"),
        r6(F.avg(timed) / safe(F.stddev_pop(timed)) * root).alias("timed_sharpe"), r6(F.avg(fwd) / safe(F.stddev_pop(fwd)) * root).alias("hold_sharpe"),
        r6(F.avg(F.when(long, fwd))).alias("mean_backwardated"), r6(F.avg(F.when(~long, fwd))).alias("mean_contango"),
    )
