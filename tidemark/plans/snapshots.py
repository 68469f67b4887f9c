"""Snapshots of outside sources, each by its own formula, and the template of features they fill."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import series as S
from ..functions.series import clip
from ..operators.bars import BARS_SQL, daily_bars, table
from .registry import query

# The features of outside sources and what stands for them where a source has none.
TEMPLATE = {
    "eia_data_quality": 0, "eia_supply_level": 50, "eia_supply_trend": 0,
    "fred_data_quality": 0, "fred_dollar_strength": 100, "fred_dollar_trend": 0, "fred_economic_stability": 70,
    "alpha_vantage_data_quality": 0, "alpha_vantage_volatility": 2.5, "alpha_vantage_trend_strength": 50, "alpha_vantage_momentum_score": 0,
    "finnhub_data_quality": 0, "finnhub_sector_strength": 50, "finnhub_sector_momentum": 0,
    "news_data_quality": 0, "news_market_buzz": 50, "news_sentiment_score": 0, "news_sentiment_momentum": 0, "news_bullish_ratio": 0.5,
    "news_uncertainty_score": 0, "news_forwardness_score": 0, "news_intensity_score": 0, "news_news_volume": 10,
    "usda_data_quality": 0, "usda_agricultural_impact": 50, "usda_corn_price_level": 5.0, "usda_biofuel_demand": 50,
    "noaa_data_quality": 0, "noaa_weather_impact": 30, "noaa_temperature_anomaly": 5, "noaa_seasonal_demand": 60,
    "geopolitical_data_quality": 0, "geopolitical_geo_risk_score": 0, "geopolitical_iran_articles": 0, "geopolitical_opec_articles": 0, "geopolitical_conflict_articles": 0,
}

FORMULAS_SQL = f"""{BARS_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY d DESC) AS back FROM r),
price AS (SELECT series_id AS k, avg(close) FILTER (WHERE back <= 10) AS m10, regr_slope(close, -back) FILTER (WHERE back <= 10) AS s10, stddev_pop(close) FILTER (WHERE back <= 30) AS sd30, avg(close) FILTER (WHERE back <= 30) AS m30, regr_slope(close, -back) FILTER (WHERE back <= 30) AS s30, max(r) FILTER (WHERE back = 1) AS day FROM b GROUP BY 1),
ev AS (SELECT event_id, user_id, value, event_type, CASE event_id % 4 WHEN 0 THEN '(D)' WHEN 1 THEN '' WHEN 2 THEN '1,' || CAST(event_id % 900 + 100 AS VARCHAR) ELSE CAST(event_id % 9 AS VARCHAR) || '.5' END AS txt FROM events),
corn AS (SELECT user_id, avg(p) AS p FROM (SELECT user_id, CAST(replace(txt, ',', '') AS DOUBLE) AS p, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM ev WHERE regexp_full_match(replace(replace(txt, '.', ''), ',', ''), '[0-9]+')) WHERE n <= 5 GROUP BY 1),
temp AS (SELECT user_id, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) / count(*) / 10 AS t FROM ev WHERE event_type = 'view' GROUP BY 1),
f AS (SELECT k AS key, 'fred_dollar_trend' AS feature, s10 / nullif(m10, 0) AS value FROM price UNION ALL SELECT k, 'fred_economic_stability', least(100, greatest(0, 100 * (1 - abs(s10 / nullif(m10, 0)) / 0.005))) FROM price
  UNION ALL SELECT k, 'alpha_vantage_volatility', 100 * sd30 / nullif(m30, 0) FROM price UNION ALL SELECT k, 'alpha_vantage_momentum_score', 100 * s30 / nullif(m30, 0) FROM price
  UNION ALL SELECT 'all', 'finnhub_sector_strength', least(100, greatest(0, 50 + 2 * avg(100 * day))) FROM price UNION ALL SELECT 'all', 'finnhub_sector_momentum', avg(100 * day) FROM price
  UNION ALL SELECT CAST(user_id AS VARCHAR), 'usda_corn_price_level', p FROM corn UNION ALL SELECT CAST(user_id AS VARCHAR), 'usda_agricultural_impact', least(100, greatest(0, 10 * p)) FROM corn
  UNION ALL SELECT CAST(user_id AS VARCHAR), 'noaa_temperature_anomaly', abs(t - 20) FROM temp UNION ALL SELECT CAST(user_id AS VARCHAR), 'noaa_weather_impact', least(100, 2 * abs(t - 20)) FROM temp
  UNION ALL SELECT CAST(user_id AS VARCHAR), 'noaa_seasonal_demand', least(100, greatest(0, 50 + 2 * (t - 20))) FROM temp)"""


def formulas(spark, sf_dir):
    """``key, feature, value``: price series stand in for exchange rates, daily prices and sectors, events for crop prices (as text) and temperatures (in tenths)."""
    c = F.col
    bars = daily_bars(spark, sf_dir).withColumn("r", S.pct_change(c("close"), 1))
    back = bars.withColumn("back", F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("d")))).where("back <= 30")
    ten, at = F.when(c("back") <= 10, c("close")), (-c("back")).cast("double")
    price = back.groupBy(c("series_id").alias("key")).agg(
        F.avg(ten).alias("m10"), F.regr_slope(ten, F.when(c("back") <= 10, at)).alias("s10"), F.stddev_pop("close").alias("sd30"), F.avg("close").alias("m30"), F.regr_slope("close", at).alias("s30"), F.max(F.when(c("back") == 1, c("r"))).alias("day")
    )
    trend = F.try_divide(c("s10"), c("m10"))
    price_features = {"fred_dollar_trend": trend, "fred_economic_stability": clip(100 * (1 - F.abs(trend) / 0.005), 0.0, 100.0), "alpha_vantage_volatility": F.try_divide(100 * c("sd30"), c("m30")), "alpha_vantage_momentum_score": F.try_divide(100 * c("s30"), c("m30"))}
    sector = price.agg(F.lit("all").alias("key"), F.avg(100 * c("day")).alias("move"))
    i = c("event_id")
    told = F.when(i % 4 == 0, "(D)").when(i % 4 == 1, "").when(i % 4 == 2, F.concat(F.lit("1,"), (i % 900 + 100).cast("string"))).otherwise(F.concat((i % 9).cast("string"), F.lit(".5")))
    events = table(spark, sf_dir, "events").withColumn("txt", told)
    # only digits, points and commas make a number; five of a user's first ones count
    numbers = events.where(F.regexp_replace("txt", "[.,]", "").rlike("^[0-9]+$")).select("user_id", F.regexp_replace("txt", ",", "").cast("double").alias("p"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("n"))
    corn = numbers.where("n <= 5").groupBy(c("user_id").cast("string").alias("key")).agg(F.avg("p").alias("p"))
    heat = events.where("event_type = 'view'").groupBy(c("user_id").cast("string").alias("key")).agg((F.sum(c("value").cast("decimal(18,2)")).cast("double") / F.count("*") / 10).alias("t"))
    away = F.abs(c("t") - 20)
    wide = (
        (price, price_features),
        (sector, {"finnhub_sector_strength": clip(50 + 2 * c("move"), 0.0, 100.0), "finnhub_sector_momentum": c("move")}),
        (corn, {"usda_corn_price_level": c("p"), "usda_agricultural_impact": clip(10 * c("p"), 0.0, 100.0)}),
        (heat, {"noaa_temperature_anomaly": away, "noaa_weather_impact": F.least(F.lit(100.0), 2 * away), "noaa_seasonal_demand": clip(50 + 2 * (c("t") - 20), 0.0, 100.0)}),
    )
    out = None
    for rows, features in wide:
        own = rows.select("key", *(v.alias(f) for f, v in features.items())).unpivot("key", list(features), "feature", "value")
        out = own if out is None else out.unionByName(own)
    return out


def _shown(value):
    """Values to four digits; temperatures come from exact sums and stay as they are."""
    return F.when(F.col("feature").startswith("noaa"), value).otherwise(F.round(value, 4))


@query("snapshot_formulas", f"WITH {FORMULAS_SQL} SELECT key, feature, CASE WHEN feature LIKE 'noaa%' THEN value ELSE round(value, 4) END AS value FROM f")
def snapshot_formulas(spark, sf_dir):
    return formulas(spark, sf_dir).select("key", "feature", _shown(F.col("value")).alias("value"))


_DEFAULTS = ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in TEMPLATE.items())


@query(
    "snapshot_template",
    f"""WITH {FORMULAS_SQL}, t(feature, usual) AS (VALUES {_DEFAULTS}), keys AS (SELECT DISTINCT key FROM f) SELECT k.key, t.feature, CASE WHEN t.feature LIKE 'noaa%' THEN coalesce(f.value, t.usual) ELSE round(coalesce(f.value, t.usual), 4) END AS value, f.value IS NOT NULL AS is_own FROM keys k CROSS JOIN t LEFT JOIN f ON f.key = k.key AND f.feature = t.feature""",
)
def snapshot_template(spark, sf_dir):
    """All features of the template for each key: a source's own numbers, and the defaults where it has none."""
    own = formulas(spark, sf_dir).where("value IS NOT NULL").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("own"))
    keys = formulas(spark, sf_dir).select("key").distinct().join(own, "key", "left")
    usual = F.explode(F.create_map(*(x for k, v in TEMPLATE.items() for x in (F.lit(k), F.lit(float(v))))))
    rows = keys.select("key", "own", usual.alias("feature", "usual"))
    mine = F.col("own")[F.col("feature")]
    return rows.select("key", "feature", _shown(F.coalesce(mine, "usual")).alias("value"), mine.isNotNull().alias("is_own"))
