"""Models on the full matrix of features by time-series folds: bins, selection and scaling fitted in each fold's training rows alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import linear as L
from ..functions import series as S
from ..functions.series import r6
from ..sources.scratch import written
from . import features, technicals  # noqa: F401  their queries are read from the registry
from .evaluation import STEPS
from .forests import KEYS, MEMBERS, UNIT, _prepared_sql, _tree_fits_sql, kept_of, learning_rows, prepared, relevance, tree_fits
from .learning import MATRIX_SQL, matrix
from .refits import _fitted_sql, _terms_sql
from .registry import ORACLES, QUERIES, query

SOURCES = (
    "returns_and_diffs", "rolling_mean_std_zscore", "trend_slope", "realized_vol_har_features", "atr_drawdown_position", "skew_semivol_jump", "obv_and_hit_rate", "candle_features", "bollinger_regime", "ema_macd", "wilder_rsi",
    "technical_structure", "released_macro_features", "calendar_features", "market_context_catalogue",
)
DATED = ("calendar_features", "market_context_catalogue")  # one row a day for all series
LEFT_OUT = ("forward_21", "forward_rv_5", "regime")  # what lies ahead, and words
N_FEATURES = 164
FOLDS, PURGED = 2, STEPS - 1  # training ends so many rows before the test rows that no target reaches into them
BEST, RIDGE = 6, 1e-3  # features of the ridge regression; times the number of rows


def full_matrix(spark, sf_dir) -> DataFrame:
    """The matrix's rows with all features of the catalogues, null and infinite ones as 0, in order of name."""
    rows = matrix(spark, sf_dir).select("series_id", "d", "target")
    names = []
    for source in SOURCES:
        found = QUERIES[source](spark, sf_dir)
        own = [c for c in found.columns if c not in ("series_id", "d", *LEFT_OUT)]
        names += own
        keys = ["d"] if source in DATED else ["series_id", "d"]
        rows = rows.join(found.select(*keys, *(F.col(c).cast("double").alias(c) for c in own)), keys, "left")
    return rows.select("series_id", "d", "target", *(F.coalesce(S.finite(F.col(c)), F.lit(0.0)).alias(c) for c in sorted(names)))


def fold_sets(rows: DataFrame) -> DataFrame:
    """``rows`` once for each fold ``s`` that they train (``w`` 1) or test (``w`` 0): the last thirds of a series, each trained on what is before it."""
    n = F.count("*").over(Window.partitionBy("series_id"))
    rows = rows.withColumn("n", n).withColumn("s", F.explode(F.array(*(F.lit(k).cast("long") for k in range(FOLDS))))).withColumn("size", F.expr(f"n div {FOLDS + 1}"))
    at, low = F.col("i") - 1, F.col("n") - (FOLDS - F.col("s")) * F.col("size")
    w = F.when(at < low - PURGED, 1).when((at >= low) & (at < low + F.col("size")), 0).cast("long")
    return rows.withColumn("w", w).where("w IS NOT NULL").select(*KEYS, "i", "y", "v", "w")


def ridge_fits(sets: DataFrame) -> DataFrame:
    """``*KEYS, i, ridge``: a regression on the best features, scaled by the median and the quartiles of the fold's training rows."""
    cells = sets.select(*KEYS, "i", "w", F.posexplode(F.transform(F.slice("chosen", 1, BEST), lambda f: F.get("v", f).cast("double") / UNIT)).alias("slot", "value"))
    scale = cells.where("w > 0").groupBy(*KEYS, "slot").agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    scale = scale.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("slot", F.col("q")[1].alias("middle"), (F.col("q")[2] - F.col("q")[0]).alias("spread")))).alias("scale"))
    rows = sets.join(scale, KEYS)
    z = [((F.get("v", F.get("chosen", F.lit(k))).cast("double") / UNIT - F.col("scale")[k]["middle"]) / F.when(F.col("scale")[k]["spread"] > 0, F.col("scale")[k]["spread"]).otherwise(1.0)).alias(f"z{k}") for k in range(BEST)]
    rows = written(rows.select(*KEYS, "i", "w", (F.col("y").cast("double") / UNIT).alias("target"), *z), "scaled")
    x = [F.lit(1.0), *(F.col(f"z{k}") for k in range(BEST))]
    terms = L.normal_terms(x, F.col("target"), F.col("w") > 0)
    fits = L.solved(rows.groupBy(*KEYS).agg(*(F.coalesce(F.sum(t), F.lit(0.0)).alias(name) for name, t in terms.items())), len(x), RIDGE)
    return rows.where("w = 0").join(fits, KEYS).select(*KEYS, "i", "target", F.col("n").cast("long").alias("n_train"), L.applied(x).alias("ridge"))


def _sets(spark, sf_dir) -> DataFrame:
    rows = written(full_matrix(spark, sf_dir), "features")
    return fold_sets(learning_rows(rows, [c for c in rows.columns if c not in ("series_id", "d", "target")]))


def _source_sql(k: int, source: str) -> str:
    keys = "d" if source in DATED else "series_id, d"
    left_out = [c for c in LEFT_OUT if c in {"returns_and_diffs": "forward_21", "realized_vol_har_features": "forward_rv_5", "bollinger_regime": "regime"}.get(source, "")]
    own = f"* EXCLUDE ({', '.join([keys, *left_out])})"
    wide = f"SELECT {keys}, CAST(COLUMNS({own}) AS DOUBLE) FROM ({ORACLES[source]})"
    return f"u{k} AS (FROM ({wide}) UNPIVOT INCLUDE NULLS (val FOR name IN (COLUMNS(* EXCLUDE ({keys})))))"


FULL_SQL = f"""{MATRIX_SQL}, {', '.join(_source_sql(k, s) for k, s in enumerate(SOURCES))},
ua AS MATERIALIZED ({' UNION ALL '.join(f"SELECT {'mx.series_id' if s in DATED else 'u.series_id'}, u.d, name, val FROM u{k} u" + (' JOIN mx ON mx.d = u.d' if s in DATED else '') for k, s in enumerate(SOURCES))}),
nm AS MATERIALIZED (SELECT name, row_number() OVER (ORDER BY name) - 1 AS feature FROM (SELECT DISTINCT name FROM ua)),
mi_ AS (SELECT series_id, d, target, row_number() OVER (PARTITION BY series_id ORDER BY d) AS i, count(*) OVER (PARTITION BY series_id) AS n FROM mx),
lr0 AS MATERIALIZED (SELECT m.series_id, i, n, CAST(round(target * {UNIT}) AS BIGINT) AS y, list(CAST(round(CASE WHEN isfinite(val) THEN val ELSE 0 END * {UNIT}) AS BIGINT) ORDER BY feature) AS v FROM mi_ m JOIN nm ON true LEFT JOIN ua ON ua.series_id = m.series_id AND ua.d = m.d AND ua.name = nm.name GROUP BY 1, 2, 3, 4),
ts AS (SELECT * FROM (SELECT series_id, i, y, v, s, CASE WHEN i - 1 < low - {PURGED} THEN 1 WHEN i - 1 >= low AND i - 1 < low + n // {FOLDS + 1} THEN 0 END AS w FROM (SELECT *, n - ({FOLDS} - s) * (n // {FOLDS + 1}) AS low FROM lr0, range({FOLDS}) t(s))) WHERE w IS NOT NULL), {', '.join(_prepared_sql(N_FEATURES))}"""
_ZX = ["1.0", *(f"z{k}" for k in range(BEST))]
METRICS_SQL = f"""{FULL_SQL}, {', '.join(_tree_fits_sql(N_FEATURES))},
rc AS (SELECT series_id, s, slot, quantile_cont(val, [0.25, 0.5, 0.75]) AS q FROM (SELECT series_id, s, unnest(range({BEST})) AS slot, unnest(list_transform(chosen[:{BEST}], lambda f: v[f + 1] / {UNIT})) AS val FROM st WHERE w > 0) GROUP BY 1, 2, 3),
sca AS (SELECT series_id, s, list(q ORDER BY slot) AS q FROM rc GROUP BY 1, 2),
rz AS MATERIALIZED (SELECT st.series_id, s, i, w, y / {UNIT} AS target, {', '.join(f"(v[chosen[{k + 1}] + 1] / {UNIT} - q[{k + 1}][2]) / CASE WHEN q[{k + 1}][3] - q[{k + 1}][1] > 0 THEN q[{k + 1}][3] - q[{k + 1}][1] ELSE 1 END AS z{k}" for k in range(BEST))} FROM st JOIN sca USING (series_id, s)),
rs AS (SELECT series_id, s, {', '.join(f'coalesce(sum({t}), 0) AS {name}' for name, t in _terms_sql(_ZX, 'target', 'w > 0').items())} FROM rz GROUP BY 1, 2), {L.elimination_sql('rs', 'sol', len(_ZX), RIDGE)},
cvf AS (SELECT rz.series_id, rz.s, rz.i, target, n, {_fitted_sql(_ZX)} AS ridge, {', '.join(MEMBERS[:3])} FROM rz JOIN sol USING (series_id, s) JOIN tf ON tf.series_id = rz.series_id AND tf.s = rz.s AND tf.i = rz.i WHERE rz.w = 0),
cvl AS (SELECT series_id, s, n, target, unnest([{', '.join(repr(m) for m in (*MEMBERS, 'ensemble'))}]) AS model, unnest([{', '.join(MEMBERS)}, ({' + '.join(MEMBERS)}) / {len(MEMBERS)}]) AS p FROM cvf)"""


def fold_fits(spark, sf_dir) -> DataFrame:
    """Test rows of all folds with each member's forecast and their mean."""
    sets = prepared(_sets(spark, sf_dir), N_FEATURES)
    fits = ridge_fits(sets).join(tree_fits(sets), [*KEYS, "i"])
    return fits.withColumn("ensemble", sum((F.col(m) for m in MEMBERS[1:]), F.col(MEMBERS[0])) / len(MEMBERS))


@query(
    "fold_metrics",
    f"""WITH {METRICS_SQL} SELECT series_id, CAST(s AS INTEGER) AS fold, model, CAST(any_value(n) AS BIGINT) AS n_train, count(*) AS n_test, round(avg(abs(target - p)), 6) AS mae, round(sqrt(avg((target - p) ** 2)), 6) AS rmse,
    round(CASE WHEN var_pop(target) > 0 THEN greatest(0, 1 - avg((target - p) ** 2) / var_pop(target)) ELSE 0 END, 6) AS score, round(100 * avg(CASE WHEN sign(p) = sign(target) THEN 1.0 ELSE 0.0 END), 4) AS direction_accuracy FROM cvl GROUP BY ALL""",
)
def fold_metrics(spark, sf_dir):
    """Errors, validation score and directions of every member in every fold, on all features of the catalogues, selected and scaled in the fold."""
    y, p = F.col("target"), F.col("p")
    rows = fold_fits(spark, sf_dir).unpivot([*KEYS, "n_train", "target"], [*MEMBERS, "ensemble"], "model", "p")
    error, var = F.avg((y - p) * (y - p)), F.var_pop(y)
    return rows.groupBy("series_id", F.col("s").cast("int").alias("fold"), "model").agg(
        F.first("n_train").alias("n_train"), F.count("*").alias("n_test"), r6(F.avg(F.abs(y - p))).alias("mae"), r6(F.sqrt(error)).alias("rmse"), r6(F.when(var > 0, F.greatest(F.lit(0.0), 1 - error / F.when(var > 0, var))).otherwise(0.0)).alias("score"),
        F.round(100 * F.avg((S.sign(p) == S.sign(y)).cast("double")), 4).alias("direction_accuracy"),
    )


@query(
    "selection_stability",
    f"""WITH {FULL_SQL}, c AS (SELECT name AS feature, count(*) AS n_sets, round(count(*) / (SELECT count(*) FROM ch), 4) AS share, round(avg(place), 4) AS mean_place FROM pl JOIN nm USING (feature) WHERE place <= {kept_of(N_FEATURES)} GROUP BY 1)
    SELECT CAST(place AS INTEGER) AS place, feature, n_sets, share, mean_place FROM (SELECT *, row_number() OVER (ORDER BY n_sets DESC, mean_place, feature) AS place FROM c) WHERE place <= 30""",
)
def selection_stability(spark, sf_dir):
    """The thirty features that are selected in most training sets, with their share of them."""
    from ..operators.trees import with_bins
    from .forests import BINS

    sets = _sets(spark, sf_dir)
    names = sorted(c for s in SOURCES for c in QUERIES[s](spark, sf_dir).columns if c not in ("series_id", "d", *LEFT_OUT))
    places = relevance(written(with_bins(sets, KEYS, "v", BINS), "sets"), N_FEATURES).where(F.col("place") <= kept_of(N_FEATURES))
    n_sets = places.select(*KEYS).distinct().agg(F.count("*").alias("all_sets"))
    named = places.withColumn("feature", F.element_at(F.array(*map(F.lit, names)), F.col("feature") + 1))
    found = named.groupBy("feature").agg(F.count("*").alias("n_sets"), F.round(F.avg("place"), 4).alias("mean_place")).join(F.broadcast(n_sets))
    best = found.orderBy(F.desc("n_sets"), "mean_place", "feature").limit(30)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n_sets"), "mean_place", "feature"))
    return best.select(place.alias("place"), "feature", "n_sets", F.round(F.col("n_sets") / F.col("all_sets"), 4).alias("share"), "mean_place")
