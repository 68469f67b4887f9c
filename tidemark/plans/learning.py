"""Features for models, their relevance, folds and fitted ensembles."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import RobustScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import series as S
from ..functions.series import past, r6
from ..operators.bars import BARS_SQL, daily_bars, frames, numbered
from .joins import RELEASED_SQL, released
from .registry import query

FEATURES = ("return_1", "return_5", "volatility_20", "zscore_20", "up_ratio_20")
MATRIX_SQL = f"""{BARS_SQL},
x AS (SELECT series_id, d, rn, close, r AS return_1, close / lag(close, 5) OVER o - 1 AS return_5, CASE WHEN count(lr) OVER w20 = 20 THEN stddev_samp(lr) OVER w20 END AS volatility_20,
  (close - avg(close) OVER w20) / nullif(stddev_samp(close) OVER w20, 0) AS zscore_20, avg(CASE WHEN r IS NULL THEN NULL WHEN r > 0 THEN 1.0 ELSE 0.0 END) OVER w20 AS up_ratio_20, lead(close, 5) OVER o / close - 1 AS target FROM r {frames(20)}),
mx AS (SELECT * FROM x WHERE rn > 21 AND target IS NOT NULL AND volatility_20 IS NOT NULL AND zscore_20 IS NOT NULL)"""


def matrix(spark, sf_dir):
    """Rows with features known at their date and the return over the five bars to come."""
    c = F.col("close")
    bars = numbered(daily_bars(spark, sf_dir)).withColumns({"return_1": S.pct_change(c, 1), "lr": S.log_return(c)})
    std = F.stddev_samp(c).over(past(20))
    rows = bars.select(
        "series_id", "d", "rn", "close", "return_1", S.pct_change(c, 5).alias("return_5"), S.full(F.col("lr"), F.stddev_samp("lr"), 20).alias("volatility_20"), ((c - F.avg(c).over(past(20))) / F.when(std > 0, std)).alias("zscore_20"),
        F.avg((F.col("return_1") > 0).cast("double")).over(past(20)).alias("up_ratio_20"), (F.lead(c, 5).over(S.ordered()) / c - 1).alias("target"),
    )
    return rows.where("rn > 21 AND target IS NOT NULL AND volatility_20 IS NOT NULL AND zscore_20 IS NOT NULL")


@query(
    "feature_relevance",
    f"""WITH {MATRIX_SQL}, lng AS (SELECT series_id, unnest([{', '.join(repr(f) for f in FEATURES)}]) AS feature, unnest([{', '.join(FEATURES)}]) AS v, target FROM mx),
    c AS (SELECT series_id, feature, count(*) AS n, covar_samp(v, target) / nullif(stddev_samp(v) * stddev_samp(target), 0) AS rho FROM lng GROUP BY 1, 2), f AS (SELECT *, rho * rho / nullif(1 - rho * rho, 0) * (n - 2) AS f_score FROM c),
    k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY f_score DESC NULLS LAST, feature) AS place FROM f) SELECT series_id, feature, n, round(rho, 6) AS rho, round(f_score, 4) AS f_score, place <= 3 AS selected FROM k""",
)
def feature_relevance(spark, sf_dir):
    """Univariate F score of each feature and the top share of features by it."""
    rows = matrix(spark, sf_dir).unpivot(["series_id", "target"], list(FEATURES), "feature", "v")
    c = rows.groupBy("series_id", "feature").agg(F.count("*").alias("n"), F.try_divide(F.covar_samp("v", "target"), F.stddev_samp("v") * F.stddev_samp("target")).alias("rho"))
    rho = F.col("rho")
    c = c.withColumn("f_score", F.try_divide(rho * rho, 1 - rho * rho) * (F.col("n") - 2))
    place = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("f_score"), "feature"))
    return c.select("series_id", "feature", "n", r6(rho).alias("rho"), F.round("f_score", 4).alias("f_score"), (place <= 3).alias("selected"))


@query(
    "feature_drift",
    f"""WITH {MATRIX_SQL}, lng AS (SELECT series_id, d, unnest([{', '.join(repr(f) for f in FEATURES)}]) AS feature, unnest([{', '.join(FEATURES)}]) AS v FROM mx),
    s AS (SELECT series_id, feature, avg(v) AS m, stddev_samp(v) AS s, arg_max(v, d) AS latest FROM lng GROUP BY 1, 2) SELECT series_id, round(avg(abs(least(8, greatest(-8, (latest - m) / s)))), 6) AS drift_score FROM s WHERE s > 0 GROUP BY 1""",
)
def feature_drift(spark, sf_dir):
    """Mean absolute z-score of the latest features against their history, each clipped at eight."""
    rows = matrix(spark, sf_dir).unpivot(["series_id", "d"], list(FEATURES), "feature", "v")
    s = rows.groupBy("series_id", "feature").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"), F.max_by("v", "d").alias("latest")).where("s > 0")
    return s.groupBy("series_id").agg(r6(F.avg(F.abs(S.clip((F.col("latest") - F.col("m")) / F.col("s"), -8.0, 8.0)))).alias("drift_score"))


def drift_scores(spark, sf_dir):
    """``drift_score`` of every row of the matrix: mean absolute z-score of its features among all rows so far, each clipped at eight."""
    z = []
    for f in FEATURES:
        std = F.stddev_samp(f).over(past())
        z.append(F.abs(S.clip((F.col(f) - F.avg(f).over(past())) / F.when(std > 0, std), -8.0, 8.0)))
    rows = matrix(spark, sf_dir).withColumn("z", F.array_compact(F.array(*z)))
    total = F.aggregate("z", F.lit(0.0), lambda a, v: a + v)
    return rows.select("series_id", "d", (total / F.when(F.size("z") > 0, F.size("z"))).alias("drift_score"))


@query(
    "cv_folds",
    f"""WITH {MATRIX_SQL}, i AS (SELECT series_id, d, row_number() OVER (PARTITION BY series_id ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM mx),
    f AS (SELECT series_id, d, i, n, fold, n // 3 AS size, n - (2 - fold) * (n // 3) AS lo, least(3, n // 100) AS gap FROM i, (VALUES (0), (1)) t(fold))
    SELECT series_id, CAST(fold AS INTEGER) AS fold, count(*) FILTER (WHERE i < lo - gap) AS n_train, count(*) FILTER (WHERE i >= lo AND i < lo + size) AS n_test, max(d) FILTER (WHERE i < lo - gap) AS last_train, min(d) FILTER (WHERE i >= lo AND i < lo + size) AS first_test FROM f GROUP BY 1, 2""",
)
def cv_folds(spark, sf_dir):
    """Two expanding time-series folds with a gap between training and test rows."""
    rows = matrix(spark, sf_dir).select("series_id", "d")
    rows = rows.withColumns({"i": F.row_number().over(S.ordered()) - 1, "n": F.count("*").over(Window.partitionBy("series_id"))})
    rows = rows.withColumn("fold", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("size", F.expr("n div 3"))
    low, gap = F.col("n") - (2 - F.col("fold")) * F.col("size"), F.least(F.lit(3), F.expr("n div 100"))
    train, test = F.col("i") < low - gap, (F.col("i") >= low) & (F.col("i") < low + F.col("size"))
    return rows.groupBy("series_id", "fold").agg(F.count_if(train).alias("n_train"), F.count_if(test).alias("n_test"), F.max(F.when(train, F.col("d"))).alias("last_train"), F.min(F.when(test, F.col("d"))).alias("first_test"))


@query("ml_ensemble")
def ml_ensemble(spark, sf_dir):
    """Three regressors on robustly scaled features, fitted on rows whose target is known before the test rows begin, and their errors.

    The split is by date over all series: training ends fifteen calendar days before the last fifth, so that no target reaches into it.
    """
    rows = matrix(spark, sf_dir)
    bounds = rows.agg(F.percentile_approx(F.unix_date("d"), 0.8).alias("cut"))
    rows = rows.join(F.broadcast(bounds))
    train, test = rows.where(F.unix_date("d") < F.col("cut") - 15), rows.where(F.unix_date("d") >= F.col("cut"))
    models = {
        "random_forest": RandomForestRegressor(labelCol="target", featuresCol="x", numTrees=10, maxDepth=4, seed=1),
        "boosted_trees": GBTRegressor(labelCol="target", featuresCol="x", maxIter=8, maxDepth=3, seed=1),
        "ridge": LinearRegression(labelCol="target", featuresCol="x", regParam=0.1, elasticNetParam=0.0),
    }
    prepare = Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="raw"), RobustScaler(inputCol="raw", outputCol="x", withCentering=True)]).fit(train)
    train, test = prepare.transform(train), prepare.transform(test)
    scored = test
    for name, model in models.items():
        scored = model.fit(train).transform(scored).withColumnRenamed("prediction", name)
    scored = scored.withColumn("ensemble", sum((F.col(m) for m in models), F.lit(0.0)) / len(models))
    y, p = F.col("target"), F.col("p")
    return scored.unpivot(["target"], [*models, "ensemble"], "model", "p").groupBy("model").agg(
        F.count("*").alias("n"), r6(F.avg(F.abs(y - p))).alias("mae"), r6(F.sqrt(F.avg((y - p) * (y - p)))).alias("rmse"), F.round(100 * F.avg((S.sign(p) == S.sign(y)).cast("double")), 4).alias("direction_accuracy")
    )


@query(
    "source_snapshots",
    f"""WITH {RELEASED_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY d DESC) AS back FROM w),
    s AS (SELECT series_id, max(level) FILTER (WHERE back = 1) AS latest, regr_slope(level, -back) FILTER (WHERE back <= 5) AS slope, avg(level) FILTER (WHERE back <= 30) AS m, stddev_pop(level) FILTER (WHERE back <= 30) AS sd FROM t GROUP BY 1)
    SELECT series_id, latest, round(slope, 4) AS trend, round(sd, 4) AS volatility, round(least(100, greatest(0, 100 * (1 - abs(slope / nullif(m, 0)) / 0.05))), 4) AS stability, CASE WHEN latest > 0 THEN 100 ELSE 0 END AS data_quality FROM s""",
)
def source_snapshots(spark, sf_dir):
    """The latest value of each released series with the slope of its last five, the spread of its last thirty, and a stability score."""
    back = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("d")))
    rows = released(spark, sf_dir).withColumn("back", back)
    at, level = F.col("back"), F.col("level")
    s = rows.where("back <= 30").groupBy("series_id").agg(
        F.max(F.when(at == 1, level)).alias("latest"), F.regr_slope(F.when(at <= 5, level), F.when(at <= 5, (-at).cast("double"))).alias("slope"), F.avg(level).alias("m"), F.stddev_pop(level).alias("sd")
    )
    stability = S.clip(100 * (1 - F.abs(F.try_divide(F.col("slope"), F.col("m"))) / 0.05), 0.0, 100.0)
    return s.select("series_id", "latest", F.round("slope", 4).alias("trend"), F.round("sd", 4).alias("volatility"), F.round(stability, 4).alias("stability"), F.when(F.col("latest") > 0, 100).otherwise(0).alias("data_quality"))


# Defaults of the feature template; a source's own numbers take their place.
TEMPLATE = {"stocks_level": 0.0, "stocks_trend": 0.0, "fx_rate": 1.08, "sentiment": 0.0, "buzz": 50.0}


@query(
    "template_overlay",
    """WITH v AS (SELECT user_id, avg(value) FILTER (WHERE event_type = 'view') AS sentiment, avg(value) FILTER (WHERE event_type = 'signup' AND value > 100) AS fx FROM events GROUP BY 1)
    SELECT user_id, key, round(val, 6) AS value FROM (SELECT user_id, unnest(['stocks_level', 'stocks_trend', 'fx_rate', 'sentiment', 'buzz']) AS key, unnest([0.0::DOUBLE, 0.0, coalesce(fx, 1.08), coalesce(sentiment, 0.0), 50.0]) AS val FROM v)""",
)
def template_overlay(spark, sf_dir):
    """A template of default features, overridden by the numbers a payload has and not by its nulls."""
    from ..operators.bars import table

    kind, value = F.col("event_type"), F.col("value")
    v = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg(F.when(kind == "view", value)).alias("sentiment"), F.avg(F.when((kind == "signup") & (value > 100), value)).alias("fx_rate"))
    own = F.map_filter(F.create_map(F.lit("sentiment"), F.col("sentiment"), F.lit("fx_rate"), F.col("fx_rate")), lambda k, x: x.isNotNull())
    defaults = F.create_map(*(y for k, x in TEMPLATE.items() for y in (F.lit(k), F.lit(x))))
    merged = F.map_concat(F.map_filter(defaults, lambda k, x: ~F.map_contains_key(own, k)), own)
    return v.select("user_id", F.explode(merged).alias("key", "value")).select("user_id", "key", r6(F.col("value")).alias("value"))
