"""One walk-forward under several sets of features: does macro data or the timing of context inflate it?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import linear as L
from ..functions import series as S
from ..functions.series import r6
from ..sources.scratch import written
from .evaluation import COST, SIZE, STEPS
from .joins import context_features, released_series_asof
from .learning import FEATURES, MATRIX_SQL, matrix
from .refits import RIDGE, _centred_sql, _decisions, _fitted_sql, _known_sql, _terms_sql
from .registry import ORACLES, query

CONTEXT = ("dollar_zscore_20d", "vol_zscore_20d", "front_vs_equity_gap_20d")
MACRO = ("stocks_zscore_12w", "stocks_change_1w")
LAGGED = tuple(f"{c}_lagged" for c in CONTEXT)
ALL = (*FEATURES, *CONTEXT, *MACRO, *LAGGED)
#: Features of each configuration; the context is that of the same day or of the bar before.
CONFIGS = {"price_only": FEATURES, "no_macro": (*FEATURES, *CONTEXT), "all": (*FEATURES, *CONTEXT, *MACRO), "lagged": (*FEATURES, *LAGGED)}
GAP = 0.5  # of Sharpe ratios, from which one configuration is taken to know too much
THOUSAND = 1000.0  # stock changes are counted in these


def _rows(spark, sf_dir) -> DataFrame:
    context = context_features(spark, sf_dir).select("d", *CONTEXT)
    macro = released_series_asof(spark, sf_dir).select("series_id", "d", "stocks_zscore_12w", (F.col("stocks_change_1w") / THOUSAND).alias("stocks_change_1w"))
    rows = matrix(spark, sf_dir).join(context, "d", "left").join(macro, ["series_id", "d"], "left").fillna(0.0, [*CONTEXT, *MACRO])
    rows = rows.withColumns({f"{c}_lagged": F.coalesce(S.lagged(F.col(c), 1), F.col(c)) for c in CONTEXT} | {"i": F.row_number().over(S.ordered())})
    return rows.withColumns({f"{f}_c": L.centred(f) for f in ALL})


def config_fits(spark, sf_dir) -> DataFrame:
    """``series_id, d, close, target, config, p``: decision rows with a ridge forecast under each configuration.

    All come from the same running sums, written once for the decision rows: a configuration takes its part of the equations.
    """
    rows, out = _rows(spark, sf_dir), None
    x = [F.lit(1.0), *(F.col(f"{f}_c") for f in ALL)]
    rows = _decisions(rows.withColumns({f"all_{name}": c for name, c in L.known_sums(rows, L.normal_terms(x, F.col("target")), STEPS, None).items()}))
    rows = written(rows.select("series_id", "d", "close", "target", *(f"{f}_c" for f in ALL), *(c for c in rows.columns if c.startswith("all_"))), "sums")
    for config, features in CONFIGS.items():
        own = [0, *(1 + ALL.index(f) for f in features)]
        part = [F.col(f"all_a_{min(own[i], own[j])}_{max(own[i], own[j])}").alias(f"a_{i}_{j}") for i, j in L.pairs(len(own))] + [F.col(f"all_b_{k}").alias(f"b_{i}") for i, k in enumerate(own)]
        part = rows.select("series_id", "d", "close", "target", *(f"{f}_c" for f in features), F.col("all_n").alias("n"), *part)
        fits = L.solved(part, len(own), RIDGE).select("series_id", "d", "close", "target", F.lit(config).alias("config"), L.applied([x[k] for k in own]).alias("p"))
        out = fits if out is None else out.unionByName(fits)
    return out


def _config_sql(config, features):
    x = ["1.0", *(f"{f}_c" for f in features)]
    return f"ks_{config} AS ({_known_sql(_terms_sql(x, 'target'), 'expanding', 'lk')}), {L.elimination_sql(f'ks_{config}', f'sol_{config}', len(x), RIDGE)}, ft_{config} AS (SELECT series_id, close, target, '{config}' AS config, {_fitted_sql(x)} AS p FROM sol_{config})"


LEAKAGE_SQL = f"""{MATRIX_SQL}, cx AS ({ORACLES['context_features']}), mc AS ({ORACLES['released_series_asof']}),
lk0 AS (SELECT mx.*, {', '.join(f'coalesce({c}, 0) AS {c}' for c in CONTEXT)}, coalesce(stocks_zscore_12w, 0) AS stocks_zscore_12w, coalesce(stocks_change_1w, 0) / {THOUSAND} AS stocks_change_1w FROM mx LEFT JOIN cx ON cx.d = mx.d LEFT JOIN mc ON mc.d = mx.d AND mc.series_id = mx.series_id),
lk1 AS (SELECT *, {', '.join(f'coalesce(lag({c}) OVER o, {c}) AS {c}_lagged' for c in CONTEXT)}, row_number() OVER o AS i FROM lk0 WINDOW o AS (PARTITION BY series_id ORDER BY d)), lk AS (SELECT *, {_centred_sql(ALL)} FROM lk1), {', '.join(_config_sql(c, f) for c, f in CONFIGS.items())},
cf AS ({' UNION ALL '.join(f'FROM ft_{c}' for c in CONFIGS)}), ct AS (SELECT *, CASE WHEN sign(p) <> 0 THEN round(sign(p) * target * close * {SIZE} - {COST}, 2) END AS pnl FROM cf),
cs AS (SELECT series_id, config, count(*) AS n, 100 * avg(CASE WHEN sign(p) = sign(target) THEN 1.0 ELSE 0.0 END) AS accuracy, avg(abs(target - p)) AS mae, sum(pnl) AS total, avg(pnl) / nullif(stddev_samp(pnl), 0) * sqrt(252.0 / {STEPS}) AS sharpe FROM ct GROUP BY 1, 2)"""


def scores(spark, sf_dir) -> DataFrame:
    y, p = F.col("target"), F.col("p")
    rows = config_fits(spark, sf_dir)
    pnl, std = F.when(S.sign(p) != 0, F.round(S.sign(p) * y * F.col("close") * SIZE - COST, 2)), F.stddev_samp("pnl")
    rows = rows.withColumn("pnl", pnl)
    return rows.groupBy("series_id", "config").agg(
        F.count("*").alias("n"), (100 * F.avg((S.sign(p) == S.sign(y)).cast("double"))).alias("accuracy"), F.avg(F.abs(y - p)).alias("mae"), F.sum("pnl").alias("total"), (F.avg("pnl") / F.when(std > 0, std) * F.sqrt(F.lit(252.0 / STEPS))).alias("sharpe")
    )


@query("feature_mode_scores", f"WITH {LEAKAGE_SQL} SELECT series_id, config, n, round(accuracy, 4) AS direction_accuracy, round(mae, 6) AS mae, round(total, 2) AS total_pnl, round(sharpe, 4) AS sharpe FROM cs")
def feature_mode_scores(spark, sf_dir):
    """The walk-forward of a ridge regression on price features, with market context, with macro series, and with context a bar late."""
    return scores(spark, sf_dir).select("series_id", "config", "n", F.round("accuracy", 4).alias("direction_accuracy"), r6(F.col("mae")).alias("mae"), F.round("total", 2).alias("total_pnl"), F.round("sharpe", 4).alias("sharpe"))


@query(
    "leakage_verdicts",
    f"""WITH {LEAKAGE_SQL}, w AS (SELECT series_id, {', '.join(f"coalesce(max(sharpe) FILTER (WHERE config = '{c}'), 0) AS {c}_s" for c in ('no_macro', 'all', 'lagged'))}, max(accuracy) FILTER (WHERE config = 'lagged') AS lagged_accuracy FROM cs GROUP BY 1)
    SELECT series_id, round(all_s - no_macro_s, 4) AS macro_gap, CASE WHEN all_s - no_macro_s > {GAP} THEN 'risk' ELSE 'clean' END AS macro_verdict, round(no_macro_s - lagged_s, 4) AS timing_gap,
    CASE WHEN lagged_s >= no_macro_s - {GAP} AND lagged_accuracy >= 50 THEN 'clean' WHEN no_macro_s - lagged_s > {GAP} THEN 'risk' ELSE 'weak' END AS timing_verdict FROM w""",
)
def leakage_verdicts(spark, sf_dir):
    """Whether macro series or same-day context raise the Sharpe ratio by more than they could if they were known in time."""
    wide = scores(spark, sf_dir).groupBy("series_id").pivot("config", list(CONFIGS)).agg(F.first("sharpe").alias("sharpe"), F.first("accuracy").alias("accuracy"))
    s = {c: F.coalesce(f"{c}_sharpe", F.lit(0.0)) for c in CONFIGS}
    timing = F.when((s["lagged"] >= s["no_macro"] - GAP) & (F.col("lagged_accuracy") >= 50), "clean").when(s["no_macro"] - s["lagged"] > GAP, "risk").otherwise("weak")
    return wide.select(
        "series_id", F.round(s["all"] - s["no_macro"], 4).alias("macro_gap"), F.when(s["all"] - s["no_macro"] > GAP, "risk").otherwise("clean").alias("macro_verdict"), F.round(s["no_macro"] - s["lagged"], 4).alias("timing_gap"), timing.alias("timing_verdict")
    )
