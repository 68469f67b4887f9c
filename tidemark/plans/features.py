"""The rest of the feature catalogues: technical structure, market context of ten series, released macro series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import series as S
from ..functions.series import past, r6, ratio
from ..operators.asof import asof_join
from ..operators.bars import BARS_SQL, daily_bars, frames, numbered, table
from .joins import RELEASED_SQL, released
from .registry import query


def _rat(a, b, default):
    return f"(CASE WHEN {b} IS NULL OR abs({b}) < 1e-9 THEN {default} ELSE coalesce(({a}) / ({b}), {default}) END)"


TECH_SQL = f"""{BARS_SQL}, t AS (SELECT *, {', '.join(f"coalesce(close / lag(close, {n}) OVER o - 1, 0) AS ret{n}" for n in (3, 5, 10, 20, 60))},
  {', '.join(f"coalesce(stddev_samp(lr) OVER w{n}, 0) AS vol{n}" for n in (5, 20, 60))}, CASE WHEN rn >= 5 THEN avg(close) OVER w5 ELSE close END AS ma5, CASE WHEN rn >= 10 THEN avg(close) OVER w10 ELSE close END AS ma10,
  CASE WHEN rn >= 20 THEN avg(close) OVER w20 ELSE close END AS ma20, avg(close) OVER w60 AS m60, coalesce(stddev_samp(CASE WHEN r < 0 THEN r END) OVER w20, 0) AS down, coalesce(stddev_samp(CASE WHEN r > 0 THEN r END) OVER w20, 0) AS up,
  max(close) OVER w60 AS top60, min(close) OVER w60 AS low60, count(*) OVER w20 AS n20, avg(close * volume) OVER w20 AS dm, stddev_samp(close * volume) OVER w20 AS ds, avg(volume) OVER w20 AS v20,
  list(CAST(sign(coalesce(close - pc, 0)) AS BIGINT) * volume) OVER w63 AS svs FROM r {frames(5, 10, 20, 60, 63)}),
u AS (SELECT *, CASE WHEN rn >= 60 THEN m60 ELSE ma20 END AS ma60, list_filter(list_transform(range(1, len(svs) + 1), lambda k: coalesce(list_sum(svs[2:k]), 0)), lambda x: x > 0)[-10:] AS obv FROM t)"""


@query(
    "technical_structure",
    f"""WITH {TECH_SQL} SELECT series_id, d, round(ma10, 4) AS ma_10, round(ma60, 4) AS ma_60, round({_rat('close', 'ma60', 1)}, 6) AS price_to_ma60, round({_rat('ma5', 'ma20', 1)}, 6) AS ma5_to_ma20, round({_rat('ma20', 'ma60', 1)}, 6) AS ma20_to_ma60,
    round(ret3, 6) AS return_3, round(ret10, 6) AS return_10, round(ret60, 6) AS return_60, round(ret5 - ret20, 6) AS momentum_accel_5_20, round({_rat('ret5', 'vol20 * sqrt(5.0)', 0)}, 4) AS momentum_vol_ratio_5,
    round({_rat('ret20', 'greatest(vol60, 1e-9) * sqrt(20.0)', 0)}, 4) AS momentum_vol_ratio_20, round(vol60, 6) AS volatility_60, round({_rat('vol5', 'vol20', 1)}, 6) AS volatility_ratio_5_20, round({_rat('vol20', 'vol60', 1)}, 6) AS volatility_ratio_20_60,
    round({_rat('down', 'up', 1)}, 6) AS downside_upside_vol_ratio, round(CASE WHEN top60 - low60 > 1e-9 THEN (close - low60) / (top60 - low60) ELSE 0.5 END, 6) AS price_position_60,
    round(CASE WHEN n20 >= 3 AND ds >= 1e-9 THEN (close * volume - dm) / ds ELSE 0 END, 6) AS dollar_volume_zscore_20,
    round(CASE WHEN len(obv) < 3 THEN 0 ELSE list_sum(list_transform(obv, lambda x, i: (i - 1 - (len(obv) - 1) / 2.0) * ln(x))) / (len(obv) * (len(obv) * len(obv) - 1) / 12.0) END, 6) AS obv_slope_10,
    round({_rat('close - open', 'open', 0)} * {_rat('volume', 'v20', 1)}, 6) AS signed_volume_pressure FROM u""",
)
def technical_structure(spark, sf_dir):
    """Relative trend, momentum against volatility, volatility structure, breakout position and participation."""
    C, V, O = F.col("close"), F.col("volume"), F.col("open")  # noqa: E741
    bars = numbered(daily_bars(spark, sf_dir)).withColumns({"r": S.pct_change(C, 1), "lr": S.log_return(C), "sv": S.sign(F.coalesce(C - S.lagged(C, 1), F.lit(0.0))) * V})
    ret = lambda n: S.pct_change(C, n, 0.0)
    std = lambda x, n: F.coalesce(F.stddev_samp(x).over(past(n)), F.lit(0.0))
    mean = lambda n, other: F.when(F.col("rn") >= n, F.avg(C).over(past(n))).otherwise(other)
    signed = lambda keep: std(F.when(keep, F.col("r")), 20)
    top, low = F.max(C).over(past(60)), F.min(C).over(past(60))
    rows = bars.select(
        "series_id", "d", "open", "close", "volume", mean(5, C).alias("ma5"), mean(10, C).alias("ma10"), mean(20, C).alias("ma20"), mean(60, mean(20, C)).alias("ma60"),
        *(ret(n).alias(f"ret{n}") for n in (3, 5, 10, 20, 60)), *(std(F.col("lr"), n).alias(f"vol{n}") for n in (5, 20, 60)), signed(F.col("r") < 0).alias("down"), signed(F.col("r") > 0).alias("up"),
        ratio(C - low, top - low, 0.5).alias("position"), S.tail_zscore(C * V, 20).alias("dollars"), (ratio(C - O, O) * ratio(V, F.avg(V).over(past(20)), 1.0)).alias("pressure"), F.collect_list("sv").over(past(63)).alias("svs"),
    )
    # the balance restarts with the window; its slope is that of the logs of the last ten positive values
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    balance = F.filter(F.transform(F.sequence(F.lit(0), F.size("svs") - 1), lambda k: total(F.slice("svs", 2, k))), lambda x: x > 0)
    rows = rows.withColumn("obv", balance).withColumn("obv", F.slice("obv", F.greatest(F.size("obv") - 9, F.lit(1)), 10))
    m = F.size("obv").cast("double")
    tilt = F.aggregate(F.transform("obv", lambda x, i: (i - (m - 1) / 2) * F.ln(x)), F.lit(0.0), lambda s, x: s + x)
    c = F.col
    return rows.select(
        "series_id", "d", F.round("ma10", 4).alias("ma_10"), F.round("ma60", 4).alias("ma_60"), r6(ratio(C, c("ma60"), 1.0)).alias("price_to_ma60"), r6(ratio(c("ma5"), c("ma20"), 1.0)).alias("ma5_to_ma20"), r6(ratio(c("ma20"), c("ma60"), 1.0)).alias("ma20_to_ma60"),
        *(r6(c(f"ret{n}")).alias(f"return_{n}") for n in (3, 10, 60)), r6(c("ret5") - c("ret20")).alias("momentum_accel_5_20"), F.round(ratio(c("ret5"), c("vol20") * F.sqrt(F.lit(5.0))), 4).alias("momentum_vol_ratio_5"),
        F.round(ratio(c("ret20"), F.greatest(c("vol60"), F.lit(1e-9)) * F.sqrt(F.lit(20.0))), 4).alias("momentum_vol_ratio_20"), r6(c("vol60")).alias("volatility_60"), r6(ratio(c("vol5"), c("vol20"), 1.0)).alias("volatility_ratio_5_20"),
        r6(ratio(c("vol20"), c("vol60"), 1.0)).alias("volatility_ratio_20_60"), r6(ratio(c("down"), c("up"), 1.0)).alias("downside_upside_vol_ratio"), r6(c("position")).alias("price_position_60"), r6(c("dollars")).alias("dollar_volume_zscore_20"),
        r6(F.when(m < 3, 0.0).otherwise(tilt / F.when(m >= 3, m * (m * m - 1) / 12))).alias("obv_slope_10"), r6(c("pressure")).alias("signed_volume_pressure"),
    )


#: Ten series of market context: orders of each priority with even and odd keys stand in for the market's own.
CONTEXT = dict(zip(("wti", "next", "brent", "xle", "xop", "spy", "dxy", "vix", "ovx", "tnx"), ((p, k) for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW") for k in (0, 1)), strict=True))
RETURNED = ("wti", "brent", "xle", "xop", "spy", "dxy", "vix", "ovx")
_LEVELS = ", ".join(f"arg_max(o_totalprice, o_orderkey) FILTER (WHERE o_orderpriority = '{p}' AND o_orderkey % 2 = {k}) AS {v}" for v, (p, k) in CONTEXT.items())
CONTEXT_SQL = f"""k0 AS (SELECT CAST(o_orderdate AS DATE) AS d, {_LEVELS} FROM orders WHERE o_totalprice > 0 GROUP BY 1),
k1 AS (SELECT 'all' AS series_id, d, {', '.join(f"last_value({v} IGNORE NULLS) OVER (ORDER BY d) AS {v}" for v in CONTEXT)} FROM k0),
k AS (SELECT *, brent - wti AS bw, wti - next AS term, ovx / vix AS ov, {', '.join(f"{v} / lag({v}, {n}) OVER (ORDER BY d) - 1 AS {v}{n}" for v in RETURNED for n in (1, 5, 20))}, wti / lag(wti, 60) OVER (ORDER BY d) - 1 AS wti60 FROM k1)"""


def _z(v):
    return f"(CASE WHEN count({v}) OVER w20 = 20 THEN ({v} - avg({v}) OVER w20) / nullif(stddev_samp({v}) OVER w20, 0) END)"


def _corr(v):
    return f"(CASE WHEN count(wti1) OVER w20 = 20 AND count({v}1) OVER w20 = 20 AND stddev_samp(wti1) OVER w20 > 0 AND stddev_samp({v}1) OVER w20 > 0 THEN covar_samp(wti1, {v}1) OVER w20 / (stddev_samp(wti1) OVER w20 * stddev_samp({v}1) OVER w20) END)"


_SHOWN = [("wti", (5, 20, 60)), ("brent", (1, 5, 20)), ("xle", (5, 20)), ("xop", (1, 5, 20)), ("spy", (1, 5, 20)), ("dxy", (1, 5, 20)), ("vix", (1, 5)), ("ovx", (1, 5))]
_GAPS = {"wti_vs_brent_gap_5d": ("wti5", "brent5"), "wti_vs_brent_gap_20d": ("wti20", "brent20"), "wti_vs_xle_gap_20d": ("wti20", "xle20"), "wti_vs_spy_gap_20d": ("wti20", "spy20"), "energy_equity_relative_5d": ("xle5", "spy5"),
         "energy_equity_relative_20d": ("xle20", "spy20"), "exploration_relative_5d": ("xop5", "spy5"), "exploration_relative_20d": ("xop20", "spy20")}
_SCORES = {"brent_wti_spread_zscore_20d": "bw", "dxy_level_zscore_20d": "dxy", "vix_zscore_20d": "vix", "ovx_zscore_20d": "ovx", "ovx_vix_ratio_zscore_20d": "ov", "tnx_level_zscore_20d": "tnx", "term_spread_zscore_20d": "term"}
_DIFFS = {"brent_wti_spread_change_5d": ("bw", 5), "tnx_change_1d": ("tnx", 1), "tnx_change_5d": ("tnx", 5), "term_spread_change_1d": ("term", 1), "term_spread_change_5d": ("term", 5)}
_KNOWN = lambda x: f"coalesce({x}, 0)"


@query(
    "market_context_catalogue",
    f"""WITH {CONTEXT_SQL} SELECT d, {', '.join(f"round(coalesce({v}{n}, 0), 6) AS {v}_return_{n}d" for v, ns in _SHOWN for n in ns)}, {', '.join(f"round(coalesce({a} - {b}, 0), 6) AS {g}" for g, (a, b) in _GAPS.items())},
    {', '.join(f"round(coalesce({_z(v)}, 0), 6) AS {g}" for g, v in _SCORES.items())}, {', '.join(f"round(coalesce({v} - lag({v}, {n}) OVER o, 0), 2) AS {g}" for g, (v, n) in _DIFFS.items())}, {', '.join(f"round(coalesce({_corr(v)}, 0), 6) AS wti_{v}_corr_20d" for v in ("xle", "xop", "spy", "dxy", "brent", "ovx"))},
    round(coalesce(bw, 0), 2) AS brent_wti_spread, round(coalesce(brent / wti, 1), 6) AS brent_wti_ratio, {', '.join(f"round(coalesce({v}, 0), 2) AS {v}_level" for v in ("dxy", "vix", "ovx", "tnx"))}, round(coalesce(ovx - vix, 0), 2) AS ovx_vix_spread, round(coalesce(ov, 1), 6) AS ovx_vix_ratio,
    round(coalesce(term, 0), 2) AS term_spread_front_next, round(coalesce(term / wti, 0), 6) AS term_spread_pct, coalesce(CAST(term < 0 AS INTEGER), 0) AS is_contango, round(coalesce((wti / next - 1) * 252 / 5, 0), 6) AS roll_yield_5d_ann,
    {', '.join(f"round({_KNOWN(f'dxy{n}')} + {_KNOWN(f'vix{n}')} + {_KNOWN(f'ovx{n}')} - {_KNOWN(f'xle{n}')} - {_KNOWN(f'spy{n}')}, 6) AS risk_off_pressure_{n}d" for n in (1, 5))},
    round({' + '.join(_KNOWN(_z(v)) for v in ('dxy', 'vix', 'ovx', 'tnx'))} - {_KNOWN('xle20 - spy20')}, 6) AS macro_stress_score FROM k {frames(20)}""",
)
def market_context_catalogue(spark, sf_dir):
    """All context features of ten series side by side by date, gaps filled from earlier dates; one row a calendar day however many orders there are."""
    orders = table(spark, sf_dir, "orders").where("o_totalprice > 0")
    own = lambda p, k: (F.col("o_orderpriority") == p) & (F.col("o_orderkey") % 2 == k)
    levels = orders.groupBy(F.lit("all").alias("series_id"), F.col("o_orderdate").cast("date").alias("d")).agg(
        *(F.max_by(F.when(own(*x), F.col("o_totalprice")), F.when(own(*x), F.col("o_orderkey"))).alias(v) for v, x in CONTEXT.items())
    )
    rows = levels.select("series_id", "d", *(F.last(v, ignorenulls=True).over(past()).alias(v) for v in CONTEXT))
    c, zero = F.col, F.lit(0.0)
    rows = rows.withColumns({"bw": c("brent") - c("wti"), "term": c("wti") - c("next"), "ov": ratio(c("ovx"), c("vix"), None)} | {f"{v}{n}": S.pct_change(c(v), n) for v in RETURNED for n in (1, 5, 20)} | {"wti60": S.pct_change(c("wti"), 60)})
    known = lambda x: F.coalesce(x, zero)
    z = lambda v: known(S.rolling_zscore(c(v), 20))

    def corr(v):
        x, y, w = c("wti1"), c(f"{v}1"), past(20)
        spread = F.stddev_samp(x).over(w) * F.stddev_samp(y).over(w)
        return F.when((F.count(x).over(w) == 20) & (F.count(y).over(w) == 20), F.covar_samp(x, y).over(w) / F.when(spread > 0, spread))

    return rows.select(
        "d", *(r6(known(c(f"{v}{n}"))).alias(f"{v}_return_{n}d") for v, ns in _SHOWN for n in ns), *(r6(known(c(a) - c(b))).alias(g) for g, (a, b) in _GAPS.items()), *(r6(z(v)).alias(g) for g, v in _SCORES.items()),
        *(F.round(known(c(v) - S.lagged(c(v), n)), 2).alias(g) for g, (v, n) in _DIFFS.items()), *(r6(known(corr(v))).alias(f"wti_{v}_corr_20d") for v in ("xle", "xop", "spy", "dxy", "brent", "ovx")),
        F.round(known(c("bw")), 2).alias("brent_wti_spread"), r6(ratio(c("brent"), c("wti"), 1.0)).alias("brent_wti_ratio"), *(F.round(known(c(v)), 2).alias(f"{v}_level") for v in ("dxy", "vix", "ovx", "tnx")),
        F.round(known(c("ovx") - c("vix")), 2).alias("ovx_vix_spread"), r6(F.coalesce("ov", F.lit(1.0))).alias("ovx_vix_ratio"), F.round(known(c("term")), 2).alias("term_spread_front_next"), r6(ratio(c("term"), c("wti"))).alias("term_spread_pct"),
        F.coalesce((c("term") < 0).cast("int"), F.lit(0)).alias("is_contango"), r6(known((ratio(c("wti"), c("next"), None) - 1) * 252 / 5)).alias("roll_yield_5d_ann"),
        *(r6(known(c(f"dxy{n}")) + known(c(f"vix{n}")) + known(c(f"ovx{n}")) - known(c(f"xle{n}")) - known(c(f"spy{n}"))).alias(f"risk_off_pressure_{n}d") for n in (1, 5)),
        r6(z("dxy") + z("vix") + z("ovx") + z("tnx") - known(c("xle20") - c("spy20"))).alias("macro_stress_score"),
    )


#: Days from a period to its release, by frequency.
WEEKLY_LAG, MONTHLY_LAG, DAILY_LAG = 5, 15, 1
MONTHLY = {"A": "indpro", "N": "fedfunds", "R": "umcsent"}
MACRO_SQL = f"""{BARS_SQL}, {RELEASED_SQL},
w1 AS (SELECT *, level - lag(level) OVER (PARTITION BY series_id ORDER BY d) AS change FROM w),
wk AS (SELECT series_id, d + {WEEKLY_LAG} AS available, level, change, -(level - lag(level, 4) OVER o) AS draw, CASE WHEN count(level) OVER w12 = 12 THEN (level - avg(level) OVER w12) / nullif(stddev_samp(level) OVER w12, 0) END AS z_level,
  CASE WHEN count(change) OVER w12 = 12 THEN (change - avg(change) OVER w12) / nullif(stddev_samp(change) OVER w12, 0) END AS z_change FROM w1 {frames(12)}),
m0 AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS d, {', '.join(f"avg(l_extendedprice / 10000) FILTER (WHERE l_returnflag = '{k}') AS {v}" for k, v in MONTHLY.items())} FROM lineitem GROUP BY 1),
mo AS (SELECT d + {MONTHLY_LAG} AS available, indpro / lag(indpro) OVER x - 1 AS mom, indpro / lag(indpro, 12) OVER x - 1 AS yoy, fedfunds, fedfunds - lag(fedfunds, 3) OVER x AS fed3, umcsent, umcsent - lag(umcsent, 3) OVER x AS umc3 FROM m0 WINDOW x AS (ORDER BY d)),
d0 AS (SELECT CAST(l_shipdate AS DATE) AS d, 100 * (avg(l_tax) - avg(l_discount)) AS curve FROM lineitem GROUP BY 1), da AS (SELECT d + {DAILY_LAG} AS available, curve, curve - lag(curve, 20) OVER (ORDER BY d) AS curve20 FROM d0)"""


@query(
    "released_macro_features",
    f"""WITH {MACRO_SQL} SELECT n.series_id, n.d, coalesce(level, 0) AS hist_eia_stocks_level, coalesce(change, 0) AS hist_eia_stocks_change_1w, round(coalesce(z_level, 0), 6) AS hist_eia_stocks_zscore_12w, round(coalesce(z_change, 0), 6) AS hist_eia_stock_change_zscore_12w,
    coalesce(draw, 0) AS hist_eia_stock_draw_4w, round(coalesce(mom, 0), 6) AS hist_fred_indpro_mom, round(coalesce(yoy, 0), 6) AS hist_fred_indpro_yoy, round(coalesce(fedfunds, 0), 6) AS hist_fred_fedfunds_level, round(coalesce(fed3, 0), 6) AS hist_fred_fedfunds_change_3m,
    round(coalesce(umcsent, 0), 6) AS hist_fred_umcsent_level, round(coalesce(umc3, 0), 6) AS hist_fred_umcsent_change_3m, round(coalesce(curve, 0), 6) AS hist_fred_curve_slope, round(coalesce(curve20, 0), 6) AS hist_fred_curve_change_20d,
    round(coalesce(yoy, 0) - coalesce(fedfunds, 0) * 0.01 + coalesce(curve, 0) * 0.1, 6) AS hist_macro_growth_vs_rates
    FROM n ASOF LEFT JOIN wk ON n.series_id = wk.series_id AND n.d >= wk.available ASOF LEFT JOIN mo ON n.d >= mo.available ASOF LEFT JOIN da ON n.d >= da.available""",
)
def released_macro_features(spark, sf_dir):
    """Weekly, monthly and daily released series: changes at their own frequency first, then seen by bars from their release on."""
    items, c = table(spark, sf_dir, "lineitem"), F.col
    weekly = released(spark, sf_dir).withColumn("change", c("level") - S.lagged(c("level"), 1))
    weekly = weekly.select(
        "series_id", F.date_add("d", WEEKLY_LAG).alias("available"), "level", "change", (-(c("level") - S.lagged(c("level"), 4))).alias("draw"), S.rolling_zscore(c("level"), 12).alias("z_level"), S.rolling_zscore(c("change"), 12).alias("z_change")
    )
    monthly = items.groupBy(F.lit("all").alias("series_id"), F.date_trunc("month", "l_shipdate").cast("date").alias("d"))
    monthly = monthly.agg(*(F.avg(F.when(c("l_returnflag") == k, c("l_extendedprice") / 10000)).alias(v) for k, v in MONTHLY.items()))
    monthly = monthly.select(
        "series_id", F.date_add("d", MONTHLY_LAG).alias("available"), S.pct_change(c("indpro"), 1).alias("mom"), S.pct_change(c("indpro"), 12).alias("yoy"), "fedfunds", (c("fedfunds") - S.lagged(c("fedfunds"), 3)).alias("fed3"), "umcsent", (c("umcsent") - S.lagged(c("umcsent"), 3)).alias("umc3")
    )
    daily = items.groupBy(F.lit("all").alias("series_id"), c("l_shipdate").cast("date").alias("d")).agg((100 * (F.avg("l_tax") - F.avg("l_discount"))).alias("curve"))
    daily = daily.select("series_id", F.date_add("d", DAILY_LAG).alias("available"), "curve", (c("curve") - S.lagged(c("curve"), 20)).alias("curve20"))
    bars = daily_bars(spark, sf_dir).select("series_id", "d")
    # series that all bars share meet each date once
    dates = bars.select(F.lit("all").alias("series_id"), "d").distinct()
    for frame, values in ((monthly, ["mom", "yoy", "fedfunds", "fed3", "umcsent", "umc3"]), (daily, ["curve", "curve20"])):
        dates = asof_join(dates, frame, ["series_id"], "d", "available", values).drop("available")
    rows = asof_join(bars, weekly, ["series_id"], "d", "available", ["level", "change", "draw", "z_level", "z_change"]).join(dates.drop("series_id"), "d")
    known = lambda v: F.coalesce(v, F.lit(0.0))
    six = {"z_level": "eia_stocks_zscore_12w", "z_change": "eia_stock_change_zscore_12w", "mom": "fred_indpro_mom", "yoy": "fred_indpro_yoy", "fedfunds": "fred_fedfunds_level", "fed3": "fred_fedfunds_change_3m", "umcsent": "fred_umcsent_level", "umc3": "fred_umcsent_change_3m", "curve": "fred_curve_slope", "curve20": "fred_curve_change_20d"}
    return rows.select(
        "series_id", "d", *(known(v).alias(f"hist_{name}") for v, name in {"level": "eia_stocks_level", "change": "eia_stocks_change_1w", "draw": "eia_stock_draw_4w"}.items()), *(r6(known(v)).alias(f"hist_{name}") for v, name in six.items()),
        r6(known("yoy") - known("fedfunds") * 0.01 + known("curve") * 0.1).alias("hist_macro_growth_vs_rates"),
    )
