"""What is shown of forecasts and quotes: encodings, fallbacks, evidence, feed states, artifacts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import series as S
from ..functions.series import past, r2, r6, ratio
from ..operators.bars import BARS_SQL, daily_bars, frames, table
from ..sources.readers import json_documents
from ..sources.scratch import shared_path
from .evaluation import LEDGER_SQL, METRICS_SQL, ledger, metrics
from .ledgers import CALLS_SQL, resolved_calls
from .registry import query


def encoded(reference: Column, target: Column, baseline: Column | None = None) -> Column:
    """A price as the return from ``reference``, less ``baseline`` if there is one; 0 without a positive reference."""
    excess = target / F.when(reference > 0, reference) - 1 - (F.coalesce(S.finite(baseline), F.lit(0.0)) if baseline is not None else 0.0)
    return F.coalesce(excess, F.lit(0.0))


def decoded(reference: Column, value: Column, baseline: Column | None = None) -> Column:
    """The inverse of ``encoded``; 0 without a positive reference or value."""
    total = 1 + value + (F.coalesce(S.finite(baseline), F.lit(0.0)) if baseline is not None else 0.0)
    return F.coalesce(F.when(reference > 0, reference * total), F.lit(0.0))


@query(
    "target_encodings",
    f"""WITH {BARS_SQL}, b AS (SELECT series_id, d, close, lead(close, 5) OVER o AS later, coalesce(avg(r) OVER w15, 0) * 5 AS baseline FROM r {frames(15)})
    SELECT series_id, d, round(later / close - 1, 6) AS as_return, round(later / close - 1 - baseline, 6) AS as_excess, round(later, 2) AS from_return, round(later, 2) AS from_excess FROM b WHERE later IS NOT NULL""",
)
def target_encodings(spark, sf_dir):
    """Prices five bars on as returns and as returns beyond the drift, and the prices those give back."""
    C, later = F.col("close"), F.col("later")
    rows = daily_bars(spark, sf_dir).withColumn("r", S.pct_change(C, 1))
    rows = rows.select("series_id", "d", "close", F.lead(C, 5).over(S.ordered()).alias("later"), (F.coalesce(F.avg("r").over(past(15)), F.lit(0.0)) * 5).alias("baseline")).where("later IS NOT NULL")
    rows = rows.withColumns({"plain": encoded(C, later), "excess": encoded(C, later, F.col("baseline"))})
    return rows.select("series_id", "d", r6(F.col("plain")).alias("as_return"), r6(F.col("excess")).alias("as_excess"), r2(decoded(C, F.col("plain"))).alias("from_return"), r2(decoded(C, F.col("excess"), F.col("baseline"))).alias("from_excess"))


LIVE = 18
EVIDENCE_SQL = f"""{LEDGER_SQL}, e AS (SELECT user_id, horizon, count(actual) AS live_total, coalesce(100 * avg(CASE WHEN actual IS NULL THEN NULL WHEN sign(pred - price) = sign(actual - price) THEN 1.0 ELSE 0.0 END), 0) AS live_accuracy FROM led GROUP BY 1, 2),
bt AS (SELECT * FROM (VALUES ('1d', 39.4, 33), ('1w', 48.24, 199)) t(horizon, backtest_accuracy, backtest_samples)), dx AS (SELECT e.*, backtest_accuracy, coalesce(backtest_samples, 0) AS backtest_samples, live_total >= 10 AND live_accuracy >= 50 AS qualified FROM e LEFT JOIN bt USING (horizon))"""
#: Static backtest figures by horizon, which stand in where no live evidence is enough.
BACKTESTS = [("1d", 39.4, 33), ("1w", 48.24, 199)]


@query(
    "display_accuracy",
    f"""WITH {EVIDENCE_SQL}, s AS (SELECT *, CASE WHEN live_total >= {LIVE} THEN 'live' WHEN live_total > 0 AND qualified THEN 'live_sparse' WHEN backtest_accuracy IS NOT NULL THEN 'backtest' WHEN live_total > 0 THEN 'live_sparse' ELSE 'unavailable' END AS source FROM dx)
    SELECT user_id, horizon, live_total, CAST(backtest_samples AS BIGINT) AS backtest_samples, source, round(CASE WHEN source LIKE 'live%' THEN live_accuracy WHEN source = 'backtest' THEN CAST(backtest_accuracy AS DOUBLE) END, 4) AS shown FROM s""",
)
def display_accuracy(spark, sf_dir):
    """Which accuracy to show of a user's horizon: enough live forecasts, fewer that are good enough, the backtest, or what there is."""
    y, p, c = F.col("actual"), F.col("pred"), F.col("price")
    hit = F.when(y.isNotNull(), (S.sign(p - c) == S.sign(y - c)).cast("double"))
    e = ledger(spark, sf_dir).groupBy("user_id", "horizon").agg(F.count("actual").alias("live_total"), F.coalesce(100 * F.avg(hit), F.lit(0.0)).alias("live_accuracy"))
    static = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(h).alias("horizon"), F.lit(a).alias("backtest"), F.lit(n).cast("long").alias("samples")) for h, a, n in BACKTESTS))))
    e = e.join(F.broadcast(static), "horizon", "left")
    live, qualified = F.col("live_total"), (F.col("live_total") >= 10) & (F.col("live_accuracy") >= 50)
    source = F.when(live >= LIVE, "live").when((live > 0) & qualified, "live_sparse").when(F.col("backtest").isNotNull(), "backtest").when(live > 0, "live_sparse").otherwise("unavailable")
    shown = F.when(F.col("source").startswith("live"), F.col("live_accuracy")).when(F.col("source") == "backtest", F.col("backtest"))
    return e.withColumn("source", source).select("user_id", "horizon", "live_total", F.coalesce("samples", F.lit(0)).alias("backtest_samples"), "source", F.round(shown, 4).alias("shown"))


@query(
    "horizon_fallbacks",
    """WITH x AS (SELECT *, CAST(value AS DECIMAL(18, 2)) AS v FROM events), q AS (SELECT user_id, CAST(sum(v) FILTER (WHERE event_type = 'view') AS DOUBLE) / nullif(count(v) FILTER (WHERE event_type = 'view'), 0) AS live, CAST(sum(v) FILTER (WHERE event_type = 'click') AS DOUBLE) / nullif(count(v) FILTER (WHERE event_type = 'click'), 0) AS stored,
    CAST(sum(v) FILTER (WHERE event_type = 'purchase' AND event_id % 3 = 0) AS DOUBLE) / nullif(count(v) FILTER (WHERE event_type = 'purchase' AND event_id % 3 = 0), 0) AS day, CAST(sum(v) FILTER (WHERE event_type = 'signup' AND event_id % 2 = 0) AS DOUBLE) / nullif(count(v) FILTER (WHERE event_type = 'signup' AND event_id % 2 = 0), 0) AS week FROM x GROUP BY 1),
    r AS (SELECT *, CASE WHEN live > 0 THEN live WHEN stored > 0 THEN stored ELSE 0 END AS ref FROM q)
    SELECT user_id, ref AS reference_price, CASE WHEN day IS NOT NULL THEN ref + 0.1::DOUBLE * (day - ref) WHEN week IS NOT NULL THEN ref + 0.05::DOUBLE * (week - ref) ELSE ref END AS hour_forecast, CASE WHEN day IS NOT NULL THEN '1d' WHEN week IS NOT NULL THEN '1w' ELSE 'reference' END AS basis FROM r""",
)
def horizon_fallbacks(spark, sf_dir):
    """The price to measure from (a live quote before a stored one) and an hourly forecast drawn from the daily or else the weekly one."""
    kind, v, i = F.col("event_type"), F.col("value").cast("decimal(18,2)"), F.col("event_id")
    mean = lambda keep: F.try_divide(F.sum(F.when(keep, v)).cast("double"), F.count(F.when(keep, v)))  # noqa: E731  sums are exact
    q = table(spark, sf_dir, "events").groupBy("user_id").agg(
        mean(kind == "view").alias("live"), mean(kind == "click").alias("stored"), mean((kind == "purchase") & (i % 3 == 0)).alias("day"), mean((kind == "signup") & (i % 2 == 0)).alias("week")
    )
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    ref, day, week = F.coalesce(positive("live"), positive("stored"), F.lit(0.0)), F.col("day"), F.col("week")
    return q.select("user_id", ref.alias("reference_price"), F.coalesce(ref + 0.1 * (day - ref), ref + 0.05 * (week - ref), ref).alias("hour_forecast"), F.when(day.isNotNull(), "1d").when(week.isNotNull(), "1w").otherwise("reference").alias("basis"))


NOW = "2024-01-20 00:00:00"
FRESH_MINUTES, OLDEST_MINUTES, AHEAD_MINUTES = 25, 180, 5


@query(
    "live_quotes",
    f"""WITH q AS (SELECT user_id, ts, value AS price, event_id, CASE WHEN event_id % 2 = 0 THEN 'yahoo_chart' ELSE 'snapshot' END AS source, (epoch(TIMESTAMP '{NOW}') - epoch(ts)) / 60 AS age FROM events WHERE value > 0),
    k AS (SELECT * FROM q WHERE age BETWEEN -{AHEAD_MINUTES} AND {OLDEST_MINUTES}), b AS (SELECT user_id, arg_max(price, row(ts, event_id)) AS price, max(ts) AS fetched_at, arg_max(source, row(ts, event_id)) AS source, min(age) AS age FROM k GROUP BY 1),
    u AS (SELECT DISTINCT user_id FROM events) SELECT u.user_id, price, fetched_at, source, coalesce(source LIKE 'yahoo%' AND age < {FRESH_MINUTES}, FALSE) AS fresh, CASE WHEN price IS NULL THEN 'INITIALIZING' WHEN source LIKE 'yahoo%' AND age < {FRESH_MINUTES} THEN 'REAL-TIME' ELSE 'DEGRADED' END AS feed FROM u LEFT JOIN b USING (user_id)""",
)
def live_quotes(spark, sf_dir):
    """The newest usable quote of each user (positive, not from the future, at most three hours old), whether it is fresh, and the state of the feed.

    A later arrival never replaces a newer quote: the newest by its own time stands.
    """
    events, order = table(spark, sf_dir, "events"), F.struct("ts", "event_id")
    minutes = (F.unix_micros(F.lit(NOW).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 6e7
    q = events.withColumns({"age": minutes, "source": F.when(F.col("event_id") % 2 == 0, "yahoo_chart").otherwise("snapshot")})
    usable = (F.col("value") > 0) & F.col("age").between(-AHEAD_MINUTES, OLDEST_MINUTES)
    pick = lambda c: F.max_by(F.when(usable, F.col(c)), F.when(usable, order))
    b = q.groupBy("user_id").agg(pick("value").alias("price"), pick("ts").alias("fetched_at"), pick("source").alias("source"), F.min(F.when(usable, F.col("age"))).alias("age"))
    fresh = F.coalesce(F.col("source").startswith("yahoo") & (F.col("age") < FRESH_MINUTES), F.lit(False))
    feed = F.when(F.col("price").isNull(), "INITIALIZING").when(fresh, "REAL-TIME").otherwise("DEGRADED")
    return b.select("user_id", "price", "fetched_at", "source", fresh.alias("fresh"), feed.alias("feed"))


def _published(documents, name: str) -> str:
    """A folder of JSON documents, a file for each row of ``series_id, document``, and one that is broken off, as a writer that died leaves it."""
    spark = documents.sparkSession
    path = shared_path(spark, name)
    broken = documents.limit(1).select(F.lit("broken").alias("series_id"), F.substring("document", 1, 20).alias("document"))
    documents.unionByName(broken).write.partitionBy("series_id").text(path)
    return path


@query(
    "backtest_artifacts",
    f"""WITH {METRICS_SQL} SELECT series_id, model AS horizon, n AS samples, round(100.0 * hits / n, 4) AS direction_accuracy, round(mae, 4) AS mae, hits > n / 2 AS significant FROM m WHERE n >= 1 AND model <> 'naive'""",
)
def backtest_artifacts(spark, sf_dir):
    """Figures by horizon from nested JSON artifacts, a file a series, written to the shared folder and scanned there; horizons without samples and files that aren't whole are left out."""
    m = metrics(spark, sf_dir)
    report = F.struct("n", "hits", F.col("mae").alias("mean_error"))
    documents = m.groupBy("series_id").agg(F.to_json(F.struct(F.first("series_id").alias("series"), F.map_from_entries(F.collect_list(F.struct("model", F.when(F.col("model") != "naive", report).alias("report")))).alias("horizons"))).alias("document"))
    found = json_documents(spark, _published(documents, "artifacts"), "series string, horizons map<string, struct<n: long, hits: long, mean_error: double>>")
    rows = found.select(F.col("doc.series").alias("series_id"), F.explode("doc.horizons").alias("horizon", "s")).where("s.n >= 1")
    n, hits = F.col("s.n"), F.col("s.hits")
    return rows.select("series_id", "horizon", n.alias("samples"), F.round(100.0 * hits / n, 4).alias("direction_accuracy"), F.round("s.mean_error", 4).alias("mae"), (hits > n / 2).alias("significant"))


@query(
    "record_summaries",
    f"""WITH {CALLS_SQL} SELECT series_id, count(*) AS n_calls, count(*) FILTER (WHERE hit IS NOT NULL AND eligible) AS n_resolved_directional, count(*) FILTER (WHERE hit AND eligible) AS n_hits FROM scored GROUP BY 1""",
)
def record_summaries(spark, sf_dir):
    """The summary object of each published live record, read from its file without its calls; records that aren't whole or whose summary is no object are left out."""
    rows = resolved_calls(spark, sf_dir)
    scored = F.col("hit").isNotNull() & F.col("eligible")
    summary = F.struct(F.count("*").alias("n_calls"), F.count_if(scored).alias("n_resolved_directional"), F.count_if(F.col("hit") & F.col("eligible")).alias("n_hits"))
    whole = rows.groupBy("series_id").agg(F.to_json(F.struct(F.first("series_id").alias("series"), F.max("d").cast("string").alias("as_of"), summary.alias("summary"))).alias("document"))
    wrong = rows.select(F.lit("wrong").alias("series_id"), F.lit('{"series": "wrong", "summary": 3}').alias("document")).limit(1)
    found = json_documents(spark, _published(whole.unionByName(wrong), "records"), "series string, summary struct<n_calls: long, n_resolved_directional: long, n_hits: long>")
    return found.where("doc.summary IS NOT NULL").select(F.col("doc.series").alias("series_id"), "doc.summary.*")


#: Columns that a horizon goes without: those of a single session for a week, slow series for a day.
DROPPED = {
    "1w": ["open_gap_pct", "intraday_return", "candle_body_to_range", "close_location_value", "upper_wick_pct", "lower_wick_pct", "signed_volume_pressure", "gap_reversal_pressure", "range_to_atr14"],
    "1d": ["hist_eia_stocks_level", "hist_eia_stocks_zscore_12w", "hist_eia_stock_draw_4w", "hist_fred_curve_slope", "hist_fred_fedfunds_level", "hist_fred_indpro_yoy", "hist_fred_umcsent_level", "hist_fred_umcsent_change_3m", "hist_macro_growth_vs_rates"],
}
#: Feature families of a training mode; a mode takes all columns but those with these prefixes.
LEFT_OUT = {"all": (), "no_macro": ("hist_",), "price_only": ("hist_", "stocks_")}


@query(
    "feature_families",
    f"""WITH {BARS_SQL}, x AS (SELECT series_id, d, round(CASE WHEN open >= 1e-9 THEN (close - open) / open ELSE 0 END, 6) AS intraday_return, round(coalesce(r, 0), 6) AS return_1, CAST(volume AS DOUBLE) AS hist_eia_stocks_level FROM r),
    l AS (SELECT series_id, unnest(['intraday_return', 'return_1', 'hist_eia_stocks_level']) AS feature, unnest([intraday_return, return_1, hist_eia_stocks_level]) AS v FROM x),
    h AS (SELECT l.*, horizon, mode FROM l, (VALUES ('1d'), ('1w')) a(horizon), (VALUES ('all'), ('no_macro')) b(mode) WHERE NOT (horizon = '1w' AND feature = 'intraday_return') AND NOT (horizon = '1d' AND feature = 'hist_eia_stocks_level') AND NOT (mode = 'no_macro' AND feature LIKE 'hist%'))
    SELECT series_id, horizon, mode, feature, count(*) AS n, round(avg(v), 6) AS mean FROM h GROUP BY 1, 2, 3, 4""",
)
def feature_families(spark, sf_dir):
    """The columns each horizon and training mode is left with, and their means."""
    C, O = F.col("close"), F.col("open")  # noqa: E741
    x = daily_bars(spark, sf_dir).select("series_id", r6(ratio(C - O, O)).alias("intraday_return"), r6(S.pct_change(C, 1, 0.0)).alias("return_1"), F.col("volume").cast("double").alias("hist_eia_stocks_level"))
    out = None
    for horizon, dropped in DROPPED.items():
        for mode in ("all", "no_macro"):
            own = x.drop(*dropped, *(c for c in x.columns if c.startswith(LEFT_OUT[mode] or ("\0",))))
            own = own.unpivot("series_id", [c for c in own.columns if c != "series_id"], "feature", "v").select("series_id", F.lit(horizon).alias("horizon"), F.lit(mode).alias("mode"), "feature", "v")
            out = own if out is None else out.unionByName(own)
    return out.groupBy("series_id", "horizon", "mode", "feature").agg(F.count("*").alias("n"), r6(F.avg("v")).alias("mean"))


BOOSTING, BAGGING = ("xgboost", "lightgbm", "gradient_boosting"), ("random_forest", "extra_trees")


@query(
    "regime_weights",
    f"""WITH {BARS_SQL}, t AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM n), b AS (SELECT series_id, d, rn, 100 * avg(tr) OVER w14 / close AS atr, 400 * stddev_samp(close) OVER w20 / avg(close) OVER w20 AS bb FROM t {frames(14, 20)}),
    g AS (SELECT *, CASE WHEN rn < 20 THEN 'NORMAL' WHEN atr > 1.5 OR bb > 5 THEN 'HIGH' WHEN atr < 0.8 AND bb < 2 THEN 'LOW' ELSE 'NORMAL' END AS regime FROM b),
    w AS (SELECT series_id, d, regime, model, CASE WHEN regime = 'HIGH' AND model IN {BOOSTING} OR regime = 'LOW' AND model IN {BAGGING} THEN 1.5 ELSE 1.0 END AS w FROM g, (VALUES ('xgboost'), ('lightgbm'), ('random_forest'), ('extra_trees'), ('ridge')) m(model))
    SELECT series_id, d, regime, model, round(w / sum(w) OVER (PARTITION BY series_id, d), 6) AS weight, CASE WHEN regime = 'HIGH' THEN 'forecasts are less certain while volatility is high' ELSE '' END AS caveat FROM w""",
)
def regime_weights(spark, sf_dir):
    """Weights of an ensemble's models in each volatility regime, boosted or bagged ones preferred, and a caveat where one is due."""
    from .technicals import bollinger_regime

    models = F.explode(F.array(*map(F.lit, ("xgboost", "lightgbm", "random_forest", "extra_trees", "ridge"))))
    rows = bollinger_regime(spark, sf_dir).select("series_id", "d", "regime", models.alias("model"))
    regime, model = F.col("regime"), F.col("model")
    w = F.when(((regime == "HIGH") & model.isin(*BOOSTING)) | ((regime == "LOW") & model.isin(*BAGGING)), 1.5).otherwise(1.0)
    rows = rows.withColumn("w", w)
    caveat = F.when(regime == "HIGH", "forecasts are less certain while volatility is high").otherwise("")
    return rows.select("series_id", "d", "regime", "model", r6(F.col("w") / F.sum("w").over(Window.partitionBy("series_id", "d"))).alias("weight"), caveat.alias("caveat"))


@query("encoded_keys", "SELECT DISTINCT source, to_base64(encode(source)) AS base64, url_encode(source || ' & ' || coalesce(lang, '')) AS url FROM documents WHERE source IS NOT NULL")
def encoded_keys(spark, sf_dir):
    """Keys as they go into addresses and headers."""
    rows = table(spark, sf_dir, "documents").where("source IS NOT NULL").select("source", "lang").distinct()
    spaced = F.regexp_replace(F.url_encode(F.concat("source", F.lit(" & "), F.coalesce("lang", F.lit("")))), r"\+", "%20")
    return rows.select("source", F.base64(F.encode("source", "UTF-8")).alias("base64"), spaced.alias("url"))
