"""Forecasts of several horizons met at one decision time: an hourly model and two daily ones of log returns, each seen as of the hour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import linear as L
from ..functions import series as S
from ..functions.series import past, r6
from ..operators.asof import asof_join
from ..operators.bars import HOURLY_SQL, hourly_bars
from .refits import RIDGE, _fitted_sql, _terms_sql
from .registry import query

FAST, SLOW = 96, 63  # bars of a window: hours, days
LEAST_DAYS = 8  # days before the first daily forecast
DAILY = {"1d": 1, "1w": 5}  # days ahead

_HX = ["1.0", "r1", "r24", "z", "vol"]
_DX = ["1.0", "r1", "z"]


def _tail_z_sql(n):
    return f"CASE WHEN count(close) OVER w{n} >= 3 AND stddev_samp(close) OVER w{n} >= 1e-9 THEN (close - avg(close) OVER w{n}) / stddev_samp(close) OVER w{n} ELSE 0 END AS z"


def _window_sql(n):
    return f"WINDOW o AS (PARTITION BY series_id ORDER BY d), w{n} AS (PARTITION BY series_id ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _sums_sql(x, target, first, last):
    own = ", ".join(f"coalesce(sum({t}) OVER p, 0) AS {name}" for name, t in _terms_sql(x, target).items())
    return f"SELECT *, {own} FROM {{}} WINDOW p AS (PARTITION BY series_id ORDER BY d ROWS BETWEEN {first} PRECEDING AND {last} PRECEDING)"


JOINT_SQL = f"""{HOURLY_SQL},
jh0 AS (SELECT series_id, h AS d, close, coalesce(ln(close) - ln(lag(close) OVER o), 0) AS r1, coalesce(ln(close) - ln(lag(close, 24) OVER o), 0) AS r24, {_tail_z_sql(FAST)}, ln(lead(close) OVER o) - ln(close) AS target, row_number() OVER o AS i FROM hours {_window_sql(FAST)}),
jh1 AS (SELECT *, coalesce(stddev_samp(r1) OVER w{FAST}, 0) AS vol FROM jh0 {_window_sql(FAST)}), jh2 AS ({_sums_sql(_HX, 'target', FAST, 1).format('jh1')}), jh3 AS (SELECT * FROM jh2 WHERE i > {FAST}), {L.elimination_sql('jh3', 'jhs', len(_HX), RIDGE)},
jd0 AS (SELECT series_id, CAST(h AS DATE) AS d, arg_max(close, h) AS close FROM hours GROUP BY 1, 2),
jd1 AS (SELECT *, coalesce(ln(close) - ln(lag(close) OVER o), 0) AS r1, {_tail_z_sql(SLOW)}, {', '.join(f'ln(lead(close, {n}) OVER o) - ln(close) AS target_{h}' for h, n in DAILY.items())}, row_number() OVER o AS i FROM jd0 {_window_sql(SLOW)}),
{', '.join(f"js_{h} AS ({_sums_sql(_DX, f'target_{h}', 'UNBOUNDED', n).format('jd1')}), jk_{h} AS (SELECT * FROM js_{h} WHERE i > {LEAST_DAYS} AND n >= {len(_DX)}), {L.elimination_sql(f'jk_{h}', f'jl_{h}', len(_DX), RIDGE)}, jf_{h} AS (SELECT series_id, d + INTERVAL 1 DAY AS available, close * exp({_fitted_sql(_DX)}) AS forecast_{h} FROM jl_{h})" for h, n in DAILY.items())},
j1 AS (SELECT series_id, d AS h, close, close * exp({_fitted_sql(_HX)}) AS forecast_1h, close * exp(target) AS actual_1h FROM jhs),
j2 AS (SELECT j1.*, f.available AS daily_as_of, forecast_1d FROM j1 ASOF LEFT JOIN jf_1d f ON j1.series_id = f.series_id AND j1.h >= f.available),
j3 AS (SELECT j2.*, forecast_1w FROM j2 ASOF LEFT JOIN jf_1w f ON j2.series_id = f.series_id AND j2.h >= f.available)"""


def _features(bars: DataFrame, n: int) -> DataFrame:
    c = F.col("close")
    return bars.withColumns({"r1": F.coalesce(S.log_return(c), F.lit(0.0)), "z": S.tail_zscore(c, n), "i": F.row_number().over(S.ordered())})


def _fits(rows: DataFrame, x: list[str], target: str, lag: int, window: int | None, first: int) -> DataFrame:
    """``rows`` after place ``first`` with ``p``, the fitted value of a ridge regression on the rows whose target is known by then."""
    columns = [F.lit(1.0), *(F.col(c) for c in x)]
    sums = L.known_sums(rows, L.normal_terms(columns, F.col(target)), lag, window)
    own = rows.withColumns(sums).where((F.col("i") > first) & (F.col("n") >= len(columns)))
    return L.solved(own, len(columns), RIDGE).withColumn("p", L.applied(columns))


def joint(spark, sf_dir) -> DataFrame:
    """Each hour with the forecasts of an hour, a day and a week ahead; a daily forecast counts from the end of its day on."""
    hours = hourly_bars(spark, sf_dir).select("series_id", F.col("h").alias("d"), "close")
    c = F.col("close")
    fast = _features(hours, FAST).withColumns({"r24": F.coalesce(F.ln(c) - F.ln(S.lagged(c, 24)), F.lit(0.0)), "target": F.ln(F.lead(c, 1).over(S.ordered())) - F.ln(c)})
    fast = fast.withColumn("vol", F.coalesce(F.stddev_samp("r1").over(past(FAST)), F.lit(0.0)))
    rows = _fits(fast, ["r1", "r24", "z", "vol"], "target", 1, FAST, FAST)
    rows = rows.select("series_id", F.col("d").alias("h"), "close", (c * F.exp("p")).alias("forecast_1h"), (c * F.exp("target")).alias("actual_1h"))
    days = hours.groupBy("series_id", F.col("d").cast("date").alias("day")).agg(F.max_by("close", "d").alias("close")).withColumnRenamed("day", "d")
    days = _features(days, SLOW).withColumns({f"target_{h}": F.ln(F.lead(c, n).over(S.ordered())) - F.ln(c) for h, n in DAILY.items()})
    for h, n in DAILY.items():
        seen = _fits(days, ["r1", "z"], f"target_{h}", n, None, LEAST_DAYS)
        seen = seen.select("series_id", (F.col("d").cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")).alias(f"available_{h}"), (c * F.exp("p")).alias(f"forecast_{h}"))
        rows = asof_join(rows, seen, ["series_id"], "h", f"available_{h}", [f"forecast_{h}"])
    return rows.withColumnRenamed("available_1d", "daily_as_of")


@query(
    "joint_horizons",
    f"""WITH {JOINT_SQL} SELECT series_id, h, close, daily_as_of, round(forecast_1h, 4) AS forecast_1h, round(forecast_1d, 4) AS forecast_1d, round(forecast_1w, 4) AS forecast_1w, round(actual_1h, 4) AS actual_1h,
    CASE WHEN forecast_1d IS NULL THEN NULL WHEN sign(forecast_1h - close) = sign(forecast_1d - close) AND sign(forecast_1h - close) = sign(forecast_1w - close) THEN 'agree' ELSE 'mixed' END AS directions FROM j3""",
)
def joint_horizons(spark, sf_dir):
    """An hour's, a day's and a week's forecast at each hour, and whether they point the same way."""
    rows, c = joint(spark, sf_dir), F.col("close")
    side = {h: S.sign(F.col(f"forecast_{h}") - c) for h in ("1h", *DAILY)}
    directions = F.when(F.col("forecast_1d").isNull(), None).when((side["1h"] == side["1d"]) & (side["1h"] == side["1w"]), "agree").otherwise("mixed")
    return rows.select("series_id", "h", "close", "daily_as_of", *(F.round(f"forecast_{h}", 4).alias(f"forecast_{h}") for h in ("1h", *DAILY)), F.round("actual_1h", 4).alias("actual_1h"), directions.alias("directions"))
