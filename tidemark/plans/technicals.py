"""Technical features over daily and hourly bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import recursive as R
from ..functions import series as S
from ..functions.series import clip, past, r2, r6, ratio
from ..operators.bars import BARS_SQL, HOURLY_SQL, daily_bars, frames, hourly_bars, numbered
from .registry import query

TR_SQL = "greatest(high - low, abs(high - pc), abs(low - pc))"


def _true_range():
    C, H, L = F.col("close"), F.col("high"), F.col("low")  # noqa: E741
    return F.greatest(H - L, F.abs(H - S.lagged(C, 1)), F.abs(L - S.lagged(C, 1)))


@query("ohlc_bars_daily", f"WITH {BARS_SQL} SELECT series_id, d, open, high, low, close, volume FROM bars")
def ohlc_bars_daily(spark, sf_dir):
    return daily_bars(spark, sf_dir)


@query("ohlc_bars_hourly", f"WITH {HOURLY_SQL} SELECT series_id, h, open, high, low, close, volume FROM hours")
def ohlc_bars_hourly(spark, sf_dir):
    return hourly_bars(spark, sf_dir)


@query(
    "returns_and_diffs",
    f"""WITH {BARS_SQL} SELECT series_id, d, round(close / lag(close) OVER o - 1, 6) AS return_1, round(close / lag(close, 5) OVER o - 1, 6) AS return_5,
    round(close / lag(close, 20) OVER o - 1, 6) AS return_20, round(close - lag(close) OVER o, 2) AS diff_1, round(close - lag(close, 5) OVER o, 2) AS diff_5,
    round(lr, 6) AS log_return, round(lead(close, 21) OVER o / close - 1, 6) AS forward_21 FROM r {frames()}""",
)
def returns_and_diffs(spark, sf_dir):
    C = F.col("close")
    return daily_bars(spark, sf_dir).select(
        "series_id", "d",
        *(r6(S.pct_change(C, n)).alias(f"return_{n}") for n in (1, 5, 20)),
        *(r2(C - S.lagged(C, n)).alias(f"diff_{n}") for n in (1, 5)),
        r6(S.log_return(C)).alias("log_return"),
        r6(F.lead(C, 21).over(S.ordered()) / C - 1).alias("forward_21"),
    )


@query(
    "rolling_mean_std_zscore",
    f"""WITH {BARS_SQL} SELECT series_id, d, round(CASE WHEN count(close) OVER w20 = 20 THEN avg(close) OVER w20 END, 4) AS mean_20,
    round(CASE WHEN count(close) OVER w20 = 20 THEN stddev_samp(close) OVER w20 END, 2) AS std_20,
    round(CASE WHEN count(close) OVER w20 = 20 THEN (close - avg(close) OVER w20) / nullif(stddev_samp(close) OVER w20, 0) END, 6) AS zscore_20,
    round(CASE WHEN count(close) OVER w10 >= 3 AND stddev_samp(close) OVER w10 >= 1e-9 THEN (close - avg(close) OVER w10) / stddev_samp(close) OVER w10 ELSE 0 END, 6) AS tail_zscore_10,
    round(CASE WHEN count(close) OVER w60 >= 3 AND stddev_samp(close) OVER w60 >= 1e-9 THEN (close - avg(close) OVER w60) / stddev_samp(close) OVER w60 ELSE 0 END, 6) AS tail_zscore_60
    FROM n {frames(10, 20, 60)}""",
)
def rolling_mean_std_zscore(spark, sf_dir):
    C = F.col("close")
    return daily_bars(spark, sf_dir).select(
        "series_id", "d",
        F.round(S.full(C, F.avg(C), 20), 4).alias("mean_20"),
        r2(S.full(C, F.stddev_samp(C), 20)).alias("std_20"),
        r6(S.rolling_zscore(C, 20)).alias("zscore_20"),
        r6(S.tail_zscore(C, 10)).alias("tail_zscore_10"),
        r6(S.tail_zscore(C, 60)).alias("tail_zscore_60"),
    )


@query(
    "trend_slope",
    f"""WITH {BARS_SQL} SELECT series_id, d, """
    + ", ".join(f"round(CASE WHEN count(close) OVER w{n} >= 3 THEN regr_slope(ln(close), rn) OVER w{n} ELSE 0 END, 6) AS trend_slope_{n}" for n in (5, 20, 60))
    + f" FROM n {frames(5, 20, 60)}",
)
def trend_slope(spark, sf_dir):
    C = F.col("close")
    bars = numbered(daily_bars(spark, sf_dir))
    return bars.select("series_id", "d", *(r6(S.log_slope(C, n, F.col("rn"))).alias(f"trend_slope_{n}") for n in (5, 20, 60)))


@query(
    "realized_vol_har_features",
    f"""WITH {BARS_SQL} SELECT series_id, d, round(stddev_samp(lr) OVER w10, 6) AS volatility_10, """
    + ", ".join(f"round(CASE WHEN count(lr) OVER w{n} = {n} THEN sqrt(avg(lr * lr) OVER w{n}) * sqrt(252) END, 6) AS rv_{n}" for n in (5, 22, 66))
    + f""", round(CASE WHEN count(lr) OVER f5 = 5 THEN sqrt(avg(lr * lr) OVER f5) * sqrt(252) END, 6) AS forward_rv_5
    FROM r {frames(5, 10, 22, 66)}, f5 AS (PARTITION BY series_id ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)""",
)
def realized_vol_har_features(spark, sf_dir):
    C = F.col("close")
    bars = daily_bars(spark, sf_dir).withColumn("lr", S.log_return(C))
    lr, ahead = F.col("lr"), S.ordered().rowsBetween(1, 5)
    root = F.sqrt(F.lit(252.0))
    return bars.select(
        "series_id", "d",
        r6(F.stddev_samp(lr).over(past(10))).alias("volatility_10"),
        *(r6(F.sqrt(S.full(lr, F.avg(lr * lr), n)) * root).alias(f"rv_{n}") for n in (5, 22, 66)),
        r6(F.when(F.count(lr).over(ahead) == 5, F.sqrt(F.avg(lr * lr).over(ahead)) * root)).alias("forward_rv_5"),
    )


@query(
    "atr_drawdown_position",
    f"""WITH {BARS_SQL}, t AS (SELECT *, {TR_SQL} AS tr FROM n) SELECT series_id, d, """
    + ", ".join(f"round(avg(tr) OVER w{n} / close, 6) AS atr_pct_{n}" for n in (5, 14, 20))
    + ", round((tr / close) / nullif(avg(tr) OVER w14 / close, 0), 6) AS range_to_atr14, "
    + ", ".join(f"round(close / max(close) OVER w{n} - 1, 6) AS drawdown_{n}, round(close / min(close) OVER w{n} - 1, 6) AS distance_from_low_{n}" for n in (20, 60))
    + """, round(CASE WHEN max(close) OVER w20 - min(close) OVER w20 < 1e-9 THEN 0.5 ELSE (close - min(close) OVER w20) / (max(close) OVER w20 - min(close) OVER w20) END, 6) AS price_position,
    round(CASE WHEN rn >= 5 THEN avg(close) OVER w5 ELSE close END, 4) AS ma_5, round(CASE WHEN rn >= 20 THEN avg(close) OVER w20 ELSE close END, 4) AS ma_20,
    round(close / CASE WHEN rn >= 20 THEN avg(close) OVER w20 ELSE close END, 6) AS price_to_ma20 FROM t """
    + frames(5, 14, 20, 60),
)
def atr_drawdown_position(spark, sf_dir):
    C = F.col("close")
    bars = numbered(daily_bars(spark, sf_dir)).withColumn("tr", _true_range())
    tr = F.col("tr")
    top, low = F.max(C).over(past(20)), F.min(C).over(past(20))
    mean = lambda n: F.when(F.col("rn") >= n, F.avg(C).over(past(n))).otherwise(C)
    return bars.select(
        "series_id", "d",
        *(r6(F.avg(tr).over(past(n)) / C).alias(f"atr_pct_{n}") for n in (5, 14, 20)),
        r6(ratio(tr / C, F.avg(tr).over(past(14)) / C, None)).alias("range_to_atr14"),
        *(r6(C / F.max(C).over(past(n)) - 1).alias(f"drawdown_{n}") for n in (20, 60)),
        *(r6(C / F.min(C).over(past(n)) - 1).alias(f"distance_from_low_{n}") for n in (20, 60)),
        r6(ratio(C - low, top - low, 0.5)).alias("price_position"),
        F.round(mean(5), 4).alias("ma_5"), F.round(mean(20), 4).alias("ma_20"), r6(C / mean(20)).alias("price_to_ma20"),
    )


@query(
    "skew_semivol_jump",
    f"""WITH {BARS_SQL} SELECT series_id, d,
    round(CASE WHEN count(r) OVER w20 >= 3 AND stddev_pop(r) OVER w20 >= 1e-12 THEN skewness(r) OVER w20 ELSE 0 END, 6) AS return_skew_20,
    round(stddev_samp(CASE WHEN lr > 0 THEN lr END) OVER w20, 6) AS upside_vol_20, round(stddev_samp(CASE WHEN lr < 0 THEN lr END) OVER w20, 6) AS downside_vol_20,
    round(max(abs(lr)) OVER w5, 6) AS jump_abs_return_5, round(max(abs(lr)) OVER w20, 6) AS jump_abs_return_20 FROM r {frames(5, 20)}""",
)
def skew_semivol_jump(spark, sf_dir):
    C = F.col("close")
    bars = daily_bars(spark, sf_dir).withColumns({"r": S.pct_change(C, 1), "lr": S.log_return(C)})
    lr = F.col("lr")
    return bars.select(
        "series_id", "d",
        r6(S.skewness_g1(F.col("r"), past(20))).alias("return_skew_20"),
        r6(F.stddev_samp(F.when(lr > 0, lr)).over(past(20))).alias("upside_vol_20"),
        r6(F.stddev_samp(F.when(lr < 0, lr)).over(past(20))).alias("downside_vol_20"),
        *(r6(F.max(F.abs(lr)).over(past(n))).alias(f"jump_abs_return_{n}") for n in (5, 20)),
    )


@query(
    "obv_and_hit_rate",
    f"""WITH {BARS_SQL}, s AS (SELECT *, CAST(sign(coalesce(close - pc, 0)) AS BIGINT) * volume AS sv FROM n),
    o63 AS (SELECT series_id, d, rn, volume, close, pc, list(sv) OVER w63 AS svs, avg(volume) OVER w20 AS vol20, avg(volume) OVER w5 AS vol5,
            stddev_samp(volume) OVER w20 AS vs20, count(*) OVER w20 AS n20, avg(CASE WHEN pc IS NULL THEN NULL WHEN close > pc THEN 1.0 ELSE 0.0 END) OVER w5 AS hit5,
            avg(CASE WHEN pc IS NULL THEN NULL WHEN close > pc THEN 1.0 ELSE 0.0 END) OVER w20 AS hit20 FROM s {frames(5, 20, 63)})
    SELECT series_id, d, CAST(list_sum(svs[2:]) AS BIGINT) AS obv_63, round(coalesce(hit5, 0.5), 6) AS up_day_ratio_5, round(coalesce(hit20, 0.5), 6) AS up_day_ratio_20,
    round(volume / vol20, 6) AS volume_ratio, round(vol5 / vol20, 6) AS volume_trend,
    round(CASE WHEN n20 >= 3 AND vs20 >= 1e-9 THEN (volume - vol20) / vs20 ELSE 0 END, 6) AS volume_zscore_20,
    round(close * volume, 2) AS dollar_volume FROM o63""",
)
def obv_and_hit_rate(spark, sf_dir):
    C, V = F.col("close"), F.col("volume")
    bars = daily_bars(spark, sf_dir).withColumn("pc", S.lagged(C, 1))
    up = F.when(F.col("pc").isNotNull(), (C > F.col("pc")).cast("double"))
    bars = bars.withColumn("sv", S.sign(F.coalesce(C - F.col("pc"), F.lit(0.0))) * V)
    # the balance restarts at each window: its first bar has no earlier close there
    inner = F.col("sv").alias("sv")
    return bars.withColumn("svs", F.collect_list(inner).over(past(63))).select(
        "series_id", "d",
        F.when(F.size("svs") > 1, F.aggregate(F.slice("svs", 2, 63), F.lit(0).cast("long"), lambda a, x: a + x)).alias("obv_63"),
        *(r6(F.coalesce(F.avg(up).over(past(n)), F.lit(0.5))).alias(f"up_day_ratio_{n}") for n in (5, 20)),
        r6(V / F.avg(V).over(past(20))).alias("volume_ratio"),
        r6(F.avg(V).over(past(5)) / F.avg(V).over(past(20))).alias("volume_trend"),
        r6(S.tail_zscore(V, 20)).alias("volume_zscore_20"),
        r2(C * V).alias("dollar_volume"),
    )


@query(
    "candle_features",
    f"""WITH {BARS_SQL}, t AS (SELECT *, {TR_SQL} AS tr FROM n) SELECT series_id, d, round(coalesce((open - pc) / pc, 0), 6) AS open_gap_pct,
    round((close - open) / open, 6) AS intraday_return, round(tr / close, 6) AS range_pct, round(CASE WHEN abs(tr) < 1e-9 THEN 0 ELSE abs(close - open) / tr END, 6) AS candle_body_to_range,
    round(CASE WHEN high - low <= 1e-9 THEN 0 ELSE ((close - low) - (high - close)) / (high - low) END, 6) AS close_location_value,
    round((high - greatest(open, close)) / close, 6) AS upper_wick_pct, round((least(open, close) - low) / close, 6) AS lower_wick_pct,
    round(high / low, 6) AS high_low_ratio, round(coalesce((open - pc) / pc, 0) - (close - open) / open, 6) AS gap_reversal_pressure FROM t""",
)
def candle_features(spark, sf_dir):
    C, H, L, O = F.col("close"), F.col("high"), F.col("low"), F.col("open")  # noqa: E741
    bars = daily_bars(spark, sf_dir).withColumn("tr", _true_range())
    tr, pc = F.col("tr"), S.lagged(C, 1)
    gap, intraday = ratio(O - pc, pc), ratio(C - O, O)
    return bars.select(
        "series_id", "d",
        r6(gap).alias("open_gap_pct"), r6(intraday).alias("intraday_return"), r6(ratio(tr, C)).alias("range_pct"),
        r6(ratio(F.abs(C - O), tr)).alias("candle_body_to_range"),
        r6(F.when(H - L <= S.TINY, 0.0).otherwise(((C - L) - (H - C)) / F.when(H - L > S.TINY, H - L))).alias("close_location_value"),
        r6(ratio(H - F.greatest(O, C), C)).alias("upper_wick_pct"), r6(ratio(F.least(O, C) - L, C)).alias("lower_wick_pct"),
        r6(ratio(H, L, 1.0)).alias("high_low_ratio"), r6(gap - intraday).alias("gap_reversal_pressure"),
    )


@query(
    "calendar_features",
    f"""WITH {BARS_SQL} SELECT DISTINCT d, CAST(month(d) AS INTEGER) AS month, CAST(quarter(d) AS INTEGER) AS quarter, CAST(isodow(d) - 1 AS INTEGER) AS day_of_week,
    month(d) IN (3, 6, 9, 12) AS is_quarter_end, CAST(dayofyear(d) AS INTEGER) AS day_of_year, month(d) IN (12, 1, 2) AS is_winter, month(d) IN (6, 7, 8) AS is_summer FROM bars""",
)
def calendar_features(spark, sf_dir):
    month = F.month("d")
    return daily_bars(spark, sf_dir).select("d").distinct().select(
        "d", month.alias("month"), F.quarter("d").alias("quarter"), F.weekday("d").alias("day_of_week"), month.isin(3, 6, 9, 12).alias("is_quarter_end"),
        F.dayofyear("d").alias("day_of_year"), month.isin(12, 1, 2).alias("is_winter"), month.isin(6, 7, 8).alias("is_summer"),
    )


@query(
    "bollinger_regime",
    f"""WITH {BARS_SQL}, t AS (SELECT *, {TR_SQL} AS tr FROM n), b AS (SELECT series_id, d, rn, close, avg(close) OVER w20 AS m, stddev_samp(close) OVER w20 AS s,
    100 * avg(tr) OVER w14 / close AS atr, count(*) OVER w20 AS k FROM t {frames(14, 20)})
    SELECT series_id, d, round(CASE WHEN k >= 5 AND s >= 1e-9 THEN (close - (m - 2 * s)) / (4 * s) ELSE 0.5 END, 6) AS bb_position,
    round(CASE WHEN k >= 5 THEN 4 * s / m ELSE 0 END, 6) AS bb_width,
    CASE WHEN rn < 20 THEN 'NORMAL' WHEN atr > 1.5 OR 400 * s / m > 5 THEN 'HIGH' WHEN atr < 0.8 AND 400 * s / m < 2 THEN 'LOW' ELSE 'NORMAL' END AS regime FROM b""",
)
def bollinger_regime(spark, sf_dir):
    C = F.col("close")
    bars = numbered(daily_bars(spark, sf_dir)).withColumn("tr", _true_range())
    mean, std, k = F.avg(C).over(past(20)), F.stddev_samp(C).over(past(20)), F.count("*").over(past(20))
    atr, width = 100 * F.avg("tr").over(past(14)) / C, 400 * std / mean
    return bars.select(
        "series_id", "d",
        r6(F.when((k >= 5) & (std >= S.TINY), (C - (mean - 2 * std)) / F.when(std >= S.TINY, 4 * std)).otherwise(0.5)).alias("bb_position"),
        r6(F.when(k >= 5, 4 * std / mean).otherwise(0.0)).alias("bb_width"),
        F.when(F.col("rn") < 20, "NORMAL").when((atr > 1.5) | (width > 5), "HIGH").when((atr < 0.8) & (width < 2), "LOW").otherwise("NORMAL").alias("regime"),
    )


@query(
    "ema_macd",
    f"""WITH {BARS_SQL}, a AS (SELECT series_id, d, list(close) OVER w63 AS xs FROM n {frames(63)}),
    m AS (SELECT series_id, d, list_reduce(list_transform(xs, lambda x: {{'e12': x, 'e26': x, 'sig': 0.0::DOUBLE, 'last': 0.0::DOUBLE}}), lambda p, q: {{
      'e12': p.e12 + 2.0::DOUBLE / 13 * (q.e12 - p.e12), 'e26': p.e26 + 2.0::DOUBLE / 27 * (q.e26 - p.e26),
      'sig': p.sig + 0.2::DOUBLE * ((p.e12 + 2.0::DOUBLE / 13 * (q.e12 - p.e12)) - (p.e26 + 2.0::DOUBLE / 27 * (q.e26 - p.e26)) - p.sig), 'last': (p.e12 - p.e26) - p.sig}}) AS f, len(xs) AS k FROM a)
    SELECT series_id, d, round(CASE WHEN k >= 26 THEN f.e12 - f.e26 ELSE 0 END, 2) AS macd, round(CASE WHEN k >= 26 THEN f.sig ELSE 0 END, 2) AS macd_signal,
    round(CASE WHEN k >= 26 THEN f.e12 - f.e26 - f.sig ELSE 0 END, 2) AS macd_histogram,
    CASE WHEN k < 26 THEN 0 WHEN f.e12 - f.e26 > f.sig AND f.last <= 0 THEN 1 WHEN f.e12 - f.e26 < f.sig AND f.last >= 0 THEN -1 ELSE 0 END AS macd_crossover FROM m""",
)
def ema_macd(spark, sf_dir):
    bars = daily_bars(spark, sf_dir).withColumn("xs", F.collect_list("close").over(past(63)))
    bars = bars.withColumn("f", R.macd(F.col("xs")))
    enough, line = F.size("xs") >= 26, F.col("f.fast") - F.col("f.slow")
    gap = line - F.col("f.signal")
    pick = lambda x: r2(F.when(enough, x).otherwise(0.0))
    crossed = F.when(~enough, 0).when((gap > 0) & (F.col("f.gap_before") <= 0), 1).when((gap < 0) & (F.col("f.gap_before") >= 0), -1).otherwise(0)
    return bars.select("series_id", "d", pick(line).alias("macd"), pick(F.col("f.signal")).alias("macd_signal"), pick(gap).alias("macd_histogram"), crossed.alias("macd_crossover"))


_RSI_SQL = """CASE WHEN len({xs}) < 15 THEN 50 ELSE list_reduce(list_concat([{{'g': list_avg(list_transform(range(2, 16), lambda i: greatest({xs}[i] - {xs}[i - 1], 0))),
 'l': list_avg(list_transform(range(2, 16), lambda i: greatest({xs}[i - 1] - {xs}[i], 0)))}}],
 list_transform(range(16, len({xs}) + 1), lambda i: {{'g': greatest({xs}[i] - {xs}[i - 1], 0), 'l': greatest({xs}[i - 1] - {xs}[i], 0)}})),
 lambda p, q: {{'g': (p.g * 13 + q.g) / 14, 'l': (p.l * 13 + q.l) / 14}}) END"""


@query(
    "wilder_rsi",
    f"""WITH {BARS_SQL}, a AS (SELECT series_id, d, list(close) OVER w63 AS xs FROM n {frames(63)}), b AS (SELECT *, xs[:len(xs) - 5] AS ys FROM a),
    f AS (SELECT series_id, d, xs, {_RSI_SQL.format(xs="xs").replace("THEN 50", "THEN NULL")} AS p, {_RSI_SQL.format(xs="ys").replace("THEN 50", "THEN NULL")} AS q FROM b),
    v AS (SELECT series_id, d, xs, CASE WHEN p IS NULL THEN 50 WHEN p.l = 0 THEN 100 ELSE 100 - 100 / (1 + p.g / p.l) END AS rsi,
    CASE WHEN q IS NULL THEN 50 WHEN q.l = 0 THEN 100 ELSE 100 - 100 / (1 + q.g / q.l) END AS before FROM f)
    SELECT series_id, d, round(rsi, 6) AS rsi, rsi < 30 AS rsi_oversold, rsi > 70 AS rsi_overbought, round(rsi - before, 6) AS rsi_slope_5,
    CASE WHEN len(xs) < 20 THEN 0 WHEN (xs[-1] > xs[-5]) <> (rsi > before) THEN 1 ELSE -1 END AS rsi_divergence FROM v""",
)
def wilder_rsi(spark, sf_dir):
    bars = daily_bars(spark, sf_dir).withColumn("xs", F.collect_list("close").over(past(63)))
    n = F.size("xs")
    bars = bars.withColumns({"v": R.rsi(F.col("xs")), "before": R.rsi(F.slice("xs", 1, F.greatest(n - 5, F.lit(0))))})
    rsi, before = F.col("v"), F.col("before")
    rising = F.get("xs", n - 1) > F.get("xs", n - 5)
    return bars.select(
        "series_id", "d", r6(rsi).alias("rsi"), (rsi < 30).alias("rsi_oversold"), (rsi > 70).alias("rsi_overbought"), r6(rsi - before).alias("rsi_slope_5"),
        F.when(n < 20, 0).when(rising != (rsi > before), 1).otherwise(-1).alias("rsi_divergence"),
    )


@query(
    "baseline_return",
    f"""WITH {BARS_SQL} SELECT series_id, d, round(least(0.25, greatest(-0.25, 5 * (0.5 * coalesce(avg(r) OVER w15, 0) + 0.3 * coalesce(avg(r) OVER w40, 0)
    + 0.2 * coalesce(close / lag(close, 5) OVER o - 1, 0) / 5))), 6) AS baseline_return_5 FROM r {frames(15, 40)}""",
)
def baseline_return(spark, sf_dir):
    C = F.col("close")
    bars = daily_bars(spark, sf_dir).withColumn("r", S.pct_change(C, 1))
    mean = lambda n: F.coalesce(F.avg("r").over(past(n)), F.lit(0.0))
    steps = 5
    value = steps * (0.5 * mean(3 * steps) + 0.3 * mean(8 * steps) + 0.2 * S.pct_change(C, steps, 0.0) / steps)
    return bars.select("series_id", "d", r6(clip(value, -0.25, 0.25)).alias("baseline_return_5"))


@query(
    "contract_calendar",
    """WITH m AS (SELECT CAST(unnest(generate_series(DATE '2023-01-01', DATE '2026-12-01', INTERVAL 1 MONTH)) AS DATE) AS delivery),
    e AS (SELECT delivery, CAST(delivery - INTERVAL 1 MONTH AS DATE) + 24 AS d25 FROM m),
    x AS (SELECT delivery, d25 - CASE isodow(d25) WHEN 1 THEN 5 WHEN 2 THEN 5 WHEN 3 THEN 5 WHEN 7 THEN 4 ELSE 3 END AS expiry FROM e)
    SELECT 'CL' || ('FGHJKMNQUVXZ')[month(delivery)] || right(CAST(year(delivery) AS VARCHAR), 2) AS symbol, delivery, expiry,
    'CL' || ('FGHJKMNQUVXZ')[month(delivery + INTERVAL 1 MONTH)] || right(CAST(year(delivery + INTERVAL 1 MONTH) AS VARCHAR), 2) AS next_symbol,
    date_diff('day', DATE '2024-06-10', expiry) >= 7 AS viable FROM x""",
)
def contract_calendar(spark, sf_dir):
    """Monthly contracts: code, expiry on the third business day before the 25th of the month before, next code, and whether a week remains."""
    months = spark.range(48).select(F.add_months(F.to_date(F.lit("2023-01-01")), F.col("id").cast("int")).alias("delivery"))
    before = F.add_months("delivery", -1)
    days = F.filter(F.sequence(F.date_add(before, 17), F.date_add(before, 23)), lambda d: F.weekday(d) < 5)
    code = lambda d: F.concat(F.lit("CL"), F.substring(F.lit("FGHJKMNQUVXZ"), F.month(d), F.lit(1)), F.date_format(d, "yy"))
    expiry = F.element_at(days, F.lit(-3))
    return months.select(
        code("delivery").alias("symbol"), "delivery", expiry.alias("expiry"), code(F.add_months("delivery", 1)).alias("next_symbol"),
        (F.datediff(expiry, F.to_date(F.lit("2024-06-10"))) >= 7).alias("viable"),
    )


