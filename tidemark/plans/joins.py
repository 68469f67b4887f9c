"""As-of, lagged and context joins over series."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import series as S
from ..functions.series import past, r2, r6
from ..operators.asof import asof_join
from ..operators.bars import BARS_SQL, HOURLY_SQL, daily_bars, frames, hourly_bars, table
from .registry import query

#: The panel's series: front, next and context prices stand in for the market's own.
NAMES = {"1-URGENT": "front", "2-HIGH": "next", "3-MEDIUM": "dollar", "4-NOT SPECIFIED": "vol", "5-LOW": "equity"}
LAG_DAYS = 5

RELEASED_SQL = """w AS (SELECT o_orderpriority AS series_id, CAST(date_trunc('week', l_shipdate) AS DATE) AS d, sum(l_quantity) AS level
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""


def released(spark, sf_dir):
    """A weekly series of each order priority: shipped quantity, as of the week's Monday."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    week = F.date_trunc("week", "l_shipdate").cast("date")
    return rows.groupBy(F.col("o_orderpriority").alias("series_id"), week.alias("d")).agg(F.sum("l_quantity").alias("level"))


@query(
    "released_series_asof",
    f"""WITH {BARS_SQL}, {RELEASED_SQL},
    f AS (SELECT series_id, d AS period, d + {LAG_DAYS} AS available, level, level - lag(level) OVER o AS change_1w, -(level - lag(level, 4) OVER o) AS draw_4w,
      CASE WHEN count(level) OVER w12 = 12 THEN (level - avg(level) OVER w12) / nullif(stddev_samp(level) OVER w12, 0) END AS zscore_12w FROM w {frames(12)})
    SELECT n.series_id, n.d, f.available, coalesce(level, 0) AS stocks_level, coalesce(change_1w, 0) AS stocks_change_1w, coalesce(draw_4w, 0) AS stocks_draw_4w,
    round(coalesce(zscore_12w, 0), 6) AS stocks_zscore_12w FROM n ASOF LEFT JOIN f ON n.series_id = f.series_id AND n.d >= f.available""",
)
def released_series_asof(spark, sf_dir):
    """Features of a weekly series at its own frequency, seen by daily bars from five days after its period on."""
    level = F.col("level")
    weekly = released(spark, sf_dir).select(
        "series_id", F.date_add("d", LAG_DAYS).alias("available"), "level", (level - S.lagged(level, 1)).alias("change_1w"),
        (-(level - S.lagged(level, 4))).alias("draw_4w"), S.rolling_zscore(level, 12).alias("zscore_12w"),
    )
    values = ["level", "change_1w", "draw_4w", "zscore_12w"]
    bars = asof_join(daily_bars(spark, sf_dir).select("series_id", "d"), weekly, ["series_id"], "d", "available", values)
    known = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return bars.select(
        "series_id", "d", "available", known("level").alias("stocks_level"), known("change_1w").alias("stocks_change_1w"),
        known("draw_4w").alias("stocks_draw_4w"), r6(known("zscore_12w")).alias("stocks_zscore_12w"),
    )


@query(
    "forward_asof_tolerance",
    """WITH f AS (SELECT event_id, user_id, ts AS issued_at, value AS forecast, ts + INTERVAL 1 HOUR AS target FROM events WHERE event_type = 'view'),
    a AS (SELECT user_id, ts AS actual_at, max(value) AS actual FROM events WHERE event_type = 'click' GROUP BY 1, 2)
    SELECT event_id, f.user_id, issued_at, forecast, target, CASE WHEN actual_at <= target + INTERVAL 72 HOUR THEN actual_at END AS actual_at,
    CASE WHEN actual_at <= target + INTERVAL 72 HOUR THEN actual END AS actual FROM f ASOF LEFT JOIN a ON f.user_id = a.user_id AND f.target <= a.actual_at""",
)
def forward_asof_tolerance(spark, sf_dir):
    """Each forecast with the first price of its user at or within three days after its target time."""
    events = table(spark, sf_dir, "events")
    forecasts = events.where("event_type = 'view'").select(
        "event_id", "user_id", F.col("ts").alias("issued_at"), F.col("value").alias("forecast"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("target")
    )
    actuals = events.where("event_type = 'click'").groupBy("user_id", F.col("ts").alias("actual_at")).agg(F.max("value").alias("actual"))
    within = F.col("actual_at") <= F.col("target") + F.expr("INTERVAL 72 HOUR")
    return asof_join(forecasts, actuals, ["user_id"], "target", "actual_at", ["actual"], "forward", within)


@query(
    "nearest_price_24h",
    f"""WITH {HOURLY_SQL}, q AS (SELECT series_id, h, close, h - INTERVAL 24 HOUR AS wanted FROM hours),
    b AS (SELECT q.*, x.h AS before_h, x.close AS before_close FROM q ASOF LEFT JOIN hours x ON q.series_id = x.series_id AND q.wanted >= x.h),
    f AS (SELECT b.*, y.h AS after_h, y.close AS after_close FROM b ASOF LEFT JOIN hours y ON b.series_id = y.series_id AND b.wanted <= y.h),
    p AS (SELECT *, before_h IS NOT NULL AND (after_h IS NULL OR epoch(wanted) - epoch(before_h) <= epoch(after_h) - epoch(wanted)) AS earlier FROM f),
    t AS (SELECT series_id, h, close, CASE WHEN earlier THEN before_close ELSE after_close END AS price_24h, abs(epoch(CASE WHEN earlier THEN before_h ELSE after_h END) - epoch(wanted)) / 3600 AS gap FROM p)
    SELECT series_id, h, close, price_24h, round(100 * (close / nullif(price_24h, 0) - 1), 6) AS change_pct, CASE WHEN gap <= 1 THEN 'precise' WHEN gap <= 6 THEN 'good' WHEN gap <= 48 THEN 'approximate' ELSE 'stale' END AS quality FROM t""",
)
def nearest_price_24h(spark, sf_dir):
    """The price nearest to 24 hours before each hourly bar, before or after that time, and how near it is."""
    C = F.col("close")
    hours = hourly_bars(spark, sf_dir).select("series_id", "h", "close")
    asked = hours.withColumn("wanted", F.col("h") - F.expr("INTERVAL 24 HOURS"))
    for side, direction in (("before", "backward"), ("after", "forward")):
        other = hours.select("series_id", F.col("h").alias(f"{side}_h"), F.col("close").alias(f"{side}_close"))
        asked = asof_join(asked, other, ["series_id"], "wanted", f"{side}_h", [f"{side}_close"], direction)
    away = {s: F.abs(F.unix_seconds(F.col(f"{s}_h").cast("timestamp")) - F.unix_seconds(F.col("wanted").cast("timestamp"))) / 3600 for s in ("before", "after")}
    earlier = F.col("before_h").isNotNull() & (F.col("after_h").isNull() | (away["before"] <= away["after"]))
    price, gap = F.when(earlier, F.col("before_close")).otherwise(F.col("after_close")), F.when(earlier, away["before"]).otherwise(away["after"])
    quality = F.when(gap <= 1, "precise").when(gap <= 6, "good").when(gap <= 48, "approximate").otherwise("stale")
    return asked.select("series_id", "h", "close", price.alias("price_24h"), r6(100 * (F.try_divide(C, price) - 1)).alias("change_pct"), quality.alias("quality"))


@query(
    "lagged_context_join",
    f"""WITH {BARS_SQL}, ctx AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS market_volume, max(o_totalprice) AS market_high FROM orders GROUP BY 1),
    k AS (SELECT series_id, d, close, coalesce(lag(d) OVER (PARTITION BY series_id ORDER BY d), d) AS context_d FROM n)
    SELECT series_id, k.d, close, context_d, market_volume, market_high FROM k LEFT JOIN ctx ON ctx.d = k.context_d""",
)
def lagged_context_join(spark, sf_dir):
    """Context of the bar before (by place in the series, not by calendar), or of the same day for the first bar."""
    context = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("context_d")).agg(F.count("*").alias("market_volume"), F.max("o_totalprice").alias("market_high"))
    bars = daily_bars(spark, sf_dir).select("series_id", "d", "close", F.coalesce(S.lagged(F.col("d"), 1), F.col("d")).alias("context_d"))
    return bars.join(context, "context_d", "left").select("series_id", "d", "close", "context_d", "market_volume", "market_high")


@query(
    "rolling_corr",
    f"""WITH {BARS_SQL}, p AS (SELECT b.series_id, b.d, a.r AS x, b.r AS y FROM r a JOIN r b ON a.d = b.d AND a.series_id = '1-URGENT' AND b.series_id <> '1-URGENT' WHERE a.r IS NOT NULL AND b.r IS NOT NULL)
    SELECT series_id, d, round(CASE WHEN count(*) OVER w20 = 20 AND stddev_samp(x) OVER w20 > 0 AND stddev_samp(y) OVER w20 > 0
    THEN covar_samp(x, y) OVER w20 / (stddev_samp(x) OVER w20 * stddev_samp(y) OVER w20) END, 6) AS corr_20 FROM p {frames(20)}""",
)
def rolling_corr(spark, sf_dir):
    """Correlation of each series' returns with the front's over the last 20 days both have."""
    C = F.col("close")
    bars = daily_bars(spark, sf_dir).select("series_id", "d", S.pct_change(C, 1).alias("r")).where("r IS NOT NULL")
    front = bars.where("series_id = '1-URGENT'").select("d", F.col("r").alias("x"))
    pairs = bars.where("series_id <> '1-URGENT'").join(front, "d").withColumnRenamed("r", "y")
    x, y, w = F.col("x"), F.col("y"), past(20)
    spread = F.stddev_samp(x).over(w) * F.stddev_samp(y).over(w)
    return pairs.select("series_id", "d", r6(F.when(F.count("*").over(w) == 20, F.covar_samp(x, y).over(w) / F.when(spread > 0, spread))).alias("corr_20"))


PANEL_SQL = f"""{BARS_SQL}, p0 AS (SELECT d, {', '.join(f"max(close) FILTER (WHERE series_id = '{k}') AS {v}" for k, v in NAMES.items())} FROM bars GROUP BY d),
p AS (SELECT 'all' AS series_id, d, {', '.join(f"last_value({v} IGNORE NULLS) OVER (ORDER BY d) AS {v}" for v in NAMES.values())} FROM p0)"""


def panel(spark, sf_dir):
    """The five series side by side by date, gaps filled from earlier dates; one row a calendar day however many orders there are."""
    wide = daily_bars(spark, sf_dir).groupBy("d").pivot("series_id", list(NAMES)).agg(F.first("close")).withColumn("series_id", F.lit("all"))
    return wide.select("series_id", "d", *(F.last(F.col(f"`{k}`"), ignorenulls=True).over(past()).alias(v) for k, v in NAMES.items()))


def _ret(v, n):
    return f"({v} / lag({v}, {n}) OVER o - 1)"


def _z(v, n=20):
    return f"(CASE WHEN count({v}) OVER w{n} = {n} THEN ({v} - avg({v}) OVER w{n}) / nullif(stddev_samp({v}) OVER w{n}, 0) END)"


@query(
    "context_features",
    f"""WITH {PANEL_SQL}, s AS (SELECT *, front - next AS spread FROM p) SELECT d,
    {', '.join(f"round(coalesce({_ret(v, n)}, 0), 6) AS {v}_return_{n}d" for v in ("front", "dollar", "equity") for n in (1, 5, 20))},
    round(spread, 2) AS term_spread, round(spread / nullif(next, 0), 6) AS term_spread_pct, coalesce(CAST(spread < 0 AS INTEGER), 0) AS is_contango,
    round(spread - lag(spread, 5) OVER o, 2) AS term_spread_change_5d, round(coalesce({_z('spread')}, 0), 6) AS term_spread_zscore_20d,
    round((front / nullif(next, 0) - 1) * 252 / 5, 6) AS roll_yield_5d_ann, round(coalesce({_z('dollar')}, 0), 6) AS dollar_zscore_20d, round(coalesce({_z('vol')}, 0), 6) AS vol_zscore_20d,
    round(coalesce({_ret('front', 20)} - {_ret('equity', 20)}, 0), 6) AS front_vs_equity_gap_20d FROM s {frames(20)}""",
)
def context_features(spark, sf_dir):
    """Cross-series features of the panel: returns, term spread, z-scores, relative strength."""
    rows = panel(spark, sf_dir).withColumn("spread", F.col("front") - F.col("next"))
    spread, zero = F.col("spread"), F.lit(0.0)
    ret = lambda v, n: S.pct_change(F.col(v), n)
    z = lambda v: F.coalesce(S.rolling_zscore(F.col(v), 20), zero)
    return rows.select(
        "d",
        *(r6(F.coalesce(ret(v, n), zero)).alias(f"{v}_return_{n}d") for v in ("front", "dollar", "equity") for n in (1, 5, 20)),
        r2(spread).alias("term_spread"), r6(F.try_divide(spread, F.col("next"))).alias("term_spread_pct"), F.coalesce((spread < 0).cast("int"), F.lit(0)).alias("is_contango"),
        r2(spread - S.lagged(spread, 5)).alias("term_spread_change_5d"), r6(z("spread")).alias("term_spread_zscore_20d"),
        r6((F.try_divide(F.col("front"), F.col("next")) - 1) * 252 / 5).alias("roll_yield_5d_ann"), r6(z("dollar")).alias("dollar_zscore_20d"), r6(z("vol")).alias("vol_zscore_20d"),
        r6(F.coalesce(ret("front", 20) - ret("equity", 20), zero)).alias("front_vs_equity_gap_20d"),
    )


@query(
    "risk_pressure",
    f"""WITH {PANEL_SQL} SELECT d, {', '.join(f"round(coalesce({_ret('dollar', n)}, 0) + coalesce({_ret('vol', n)}, 0) - coalesce({_ret('equity', n)}, 0), 6) AS risk_off_pressure_{n}d" for n in (1, 5))},
    round(coalesce({_z('dollar')}, 0) + coalesce({_z('vol')}, 0) - coalesce({_ret('equity', 20)} - {_ret('next', 20)}, 0), 6) AS macro_stress_score FROM p {frames(20)}""",
)
def risk_pressure(spark, sf_dir):
    """Returns of risk-off series less those of risk-on ones, nulls as 0, and a stress score."""
    rows, zero = panel(spark, sf_dir), F.lit(0.0)
    ret = lambda v, n: F.coalesce(S.pct_change(F.col(v), n), zero)
    z = lambda v: F.coalesce(S.rolling_zscore(F.col(v), 20), zero)
    gap = F.coalesce(S.pct_change(F.col("equity"), 20) - S.pct_change(F.col("next"), 20), zero)
    return rows.select(
        "d", *(r6(ret("dollar", n) + ret("vol", n) - ret("equity", n)).alias(f"risk_off_pressure_{n}d") for n in (1, 5)), r6(z("dollar") + z("vol") - gap).alias("macro_stress_score")
    )


@query(
    "prioritized_union",
    """WITH d AS (SELECT user_id, date_trunc('hour', ts) AS t, arg_max(value, row(ts, event_id)) AS price, 0 AS prio FROM events WHERE event_type = 'view' GROUP BY 1, 2),
    i AS (SELECT user_id, date_trunc('hour', ts) AS t, arg_max(value, row(ts, event_id)) AS price, 1 AS prio FROM events WHERE event_type = 'click' GROUP BY 1, 2),
    l AS (SELECT user_id, date_trunc('hour', ts) AS t, arg_max(value, row(ts, event_id)) AS price, 2 AS prio FROM events WHERE event_type = 'purchase' GROUP BY 1, 2),
    u AS (FROM d UNION ALL FROM i UNION ALL FROM l) SELECT user_id, t, arg_max(price, prio) AS price, max(prio) AS priority FROM u GROUP BY 1, 2""",
)
def prioritized_union(spark, sf_dir):
    """Three feeds of prices in one series: at equal times the feed of higher priority wins."""
    events = table(spark, sf_dir, "events")
    prio = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", 2)
    feeds = events.withColumn("prio", prio).where("prio IS NOT NULL")
    last = feeds.groupBy("user_id", F.window("ts", "1 hour").start.alias("t"))
    return last.agg(F.max_by("value", F.struct("prio", "ts", "event_id")).alias("price"), F.max("prio").alias("priority"))


@query(
    "latest_per_key",
    """SELECT user_id, event_type, arg_max(value, row(ts, event_id)) AS value, max(ts) AS ts FROM events GROUP BY 1, 2""",
)
def latest_per_key(spark, sf_dir):
    """Keep-last deduplication: of rows with one key the latest stays."""
    best = Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    rows = table(spark, sf_dir, "events").withColumn("place", F.row_number().over(best)).where("place = 1")
    return rows.select("user_id", "event_type", "value", "ts")


