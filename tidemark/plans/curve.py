"""The futures curve as a ladder of contract months: front and next contract as of each date, rolls, a back-adjusted series, carry."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import series as S
from ..functions.series import past, r6
from ..operators.asof import asof_join
from ..operators.bars import table
from .registry import query

LADDER, EXPIRY_DAY = 4, 20  # contracts quoted on a day; a contract expires on this day of the month before its own
HOLD, LEAST = 21, 100  # rows of the return ahead, rows before the first decision

LADDER_SQL = f"""lq AS (SELECT l_returnflag AS series_id, CAST(l_shipdate AS DATE) AS d, CAST(date_trunc('month', l_shipdate) + to_months(CAST(1 + l_linenumber % {LADDER} AS INTEGER)) AS DATE) AS contract, avg(l_extendedprice / l_quantity) AS settle, count(*) AS n FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2, 3),
ld AS (SELECT series_id, d, CAST(date_trunc('month', d) + to_months(CASE WHEN day(d) < {EXPIRY_DAY} THEN 1 ELSE 2 END) AS DATE) AS front FROM (SELECT DISTINCT series_id, d FROM lq)),
l1 AS (SELECT ld.*, CAST(front + to_months(1) AS DATE) AS nxt, q.settle AS c1 FROM ld ASOF LEFT JOIN lq q ON ld.series_id = q.series_id AND ld.front = q.contract AND ld.d >= q.d),
l2 AS (SELECT l1.*, q.settle AS c2 FROM l1 ASOF LEFT JOIN lq q ON l1.series_id = q.series_id AND l1.nxt = q.contract AND l1.d >= q.d),
l3 AS (SELECT *, lag(front) OVER o <> front AS rolled, lag(c2) OVER o - lag(c1) OVER o AS step FROM l2 WHERE c1 > 0 AND c2 > 0 WINDOW o AS (PARTITION BY series_id ORDER BY d)),
cv AS (SELECT *, CASE WHEN rolled THEN step ELSE 0 END AS gap, c1 + coalesce(sum(CASE WHEN rolled THEN step ELSE 0 END) OVER (PARTITION BY series_id ORDER BY d ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS adjusted FROM l3)"""


def ladder(spark, sf_dir):
    """Settlements ``series_id, d, contract, settle, n`` by day and contract month."""
    rows = table(spark, sf_dir, "lineitem").where("l_quantity > 0")
    day = F.col("l_shipdate").cast("date")
    contract = F.add_months(F.trunc(day, "month"), 1 + F.col("l_linenumber").cast("int") % LADDER)
    return rows.groupBy(F.col("l_returnflag").alias("series_id"), day.alias("d"), contract.alias("contract")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("settle"), F.count("*").alias("n"))


def curve(spark, sf_dir):
    """One row a day: the contract that is front then, the one after it, the last settlement of each by then, and the series adjusted back for rolls.

    At a roll the new front's level differs from the old one's by what they differed the day before; all earlier days are shifted by it.
    """
    quotes = ladder(spark, sf_dir)
    days = quotes.select("series_id", "d").distinct()
    front = F.add_months(F.trunc("d", "month"), F.when(F.dayofmonth("d") < EXPIRY_DAY, 1).otherwise(2))
    rows = days.withColumn("front", front).withColumn("next", F.add_months("front", 1))
    for contract, price in (("front", "c1"), ("next", "c2")):
        own = quotes.select("series_id", F.col("contract").alias(contract), F.col("d").alias(f"{price}_d"), F.col("settle").alias(price))
        rows = asof_join(rows, own, ["series_id", contract], "d", f"{price}_d", [price])
    rows = rows.where("c1 > 0 AND c2 > 0").withColumns({"rolled": S.lagged(F.col("front"), 1) != F.col("front"), "step": S.lagged(F.col("c2"), 1) - S.lagged(F.col("c1"), 1)})
    rows = rows.withColumn("gap", F.when(F.col("rolled"), F.col("step")).otherwise(0.0))
    later = F.sum("gap").over(Window.partitionBy("series_id")) - F.sum("gap").over(past())
    return rows.withColumn("adjusted", F.col("c1") + later)


@query(
    "futures_curve",
    f"""WITH {LADDER_SQL} SELECT series_id, d, front AS front_contract, nxt AS next_contract, round(c1, 8) AS front, round(c2, 8) AS next, round((c1 - c2) / c2, 6) AS carry, CASE WHEN c1 > c2 THEN 'backwardation' WHEN c1 < c2 THEN 'contango' ELSE 'flat' END AS shape, coalesce(rolled, FALSE) AS rolled, round(gap, 8) AS roll_gap, round(adjusted, 5) AS adjusted FROM cv""",
)
def futures_curve(spark, sf_dir):
    """Front and next contract of each day with carry, rolls and the back-adjusted front."""
    a, b = F.col("c1"), F.col("c2")
    shape = F.when(a > b, "backwardation").when(a < b, "contango").otherwise("flat")
    return curve(spark, sf_dir).select(
        "series_id", "d", F.col("front").alias("front_contract"), F.col("next").alias("next_contract"), F.round(a, 8).alias("front"), F.round(b, 8).alias("next"), r6((a - b) / b).alias("carry"), shape.alias("shape"), F.coalesce("rolled", F.lit(False)).alias("rolled"),
        F.round("gap", 8).alias("roll_gap"), F.round("adjusted", 5).alias("adjusted"),
    )


@query(
    "carry_walkforward",
    f"""WITH {LADDER_SQL}, k0 AS (SELECT series_id, d, (c1 - c2) / c2 AS carry, row_number() OVER o AS i, round((lead(adjusted, {HOLD}) OVER o - adjusted) / c1, 9) AS fwd FROM cv WINDOW o AS (PARTITION BY series_id ORDER BY d)),
    k1 AS (SELECT *, quantile_cont(carry, 0.5) OVER (PARTITION BY series_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND {HOLD} PRECEDING) AS threshold FROM k0),
    k AS (SELECT *, carry > threshold AS long FROM k1 WHERE i > {LEAST} AND (i - 1) % 5 = 0 AND fwd IS NOT NULL)
    SELECT series_id, count(*) AS n, round(avg(CASE WHEN long = (fwd > 0) THEN 1.0 ELSE 0.0 END), 6) AS direction_accuracy, round(greatest(avg(CASE WHEN fwd > 0 THEN 1.0 ELSE 0.0 END), 1 - avg(CASE WHEN fwd > 0 THEN 1.0 ELSE 0.0 END)), 6) AS base_rate,
    round(avg(CASE WHEN long THEN fwd ELSE 0 END) / nullif(stddev_pop(CASE WHEN long THEN fwd ELSE 0 END), 0) * sqrt(252.0 / {HOLD}), 6) AS timed_sharpe, round(avg(fwd) / nullif(stddev_pop(fwd), 0) * sqrt(252.0 / {HOLD}), 6) AS hold_sharpe FROM k GROUP BY 1""",
)
def carry_walkforward(spark, sf_dir):
    """Long while carry is above the median of what was known when its own returns were: returns of the back-adjusted front, so that rolls don't count as gains."""
    a, b, adjusted = F.col("c1"), F.col("c2"), F.col("adjusted")
    rows = curve(spark, sf_dir).select("series_id", "d", ((a - b) / b).alias("carry"), F.row_number().over(S.ordered()).alias("i"), F.round((F.lead(adjusted, HOLD).over(S.ordered()) - adjusted) / a, 9).alias("fwd"))
    rows = rows.withColumn("threshold", F.percentile("carry", 0.5).over(past().rowsBetween(Window.unboundedPreceding, -HOLD)))
    rows = rows.where((F.col("i") > LEAST) & ((F.col("i") - 1) % 5 == 0) & F.col("fwd").isNotNull())
    long, fwd = F.col("carry") > F.col("threshold"), F.col("fwd")
    timed, up, root = F.when(long, fwd).otherwise(0.0), F.avg((fwd > 0).cast("double")), F.sqrt(F.lit(252.0 / HOLD))
    safe = lambda x: F.when(x > 0, x)
    return rows.groupBy("series_id").agg(
        F.count("*").alias("n"), r6(F.avg((long == (fwd > 0)).cast("double"))).alias("direction_accuracy"), r6(F.greatest(up, 1 - up)).alias("base_rate"), r6(F.avg(timed) / safe(F.stddev_pop(timed)) * root).alias("timed_sharpe"), r6(F.avg(fwd) / safe(F.stddev_pop(fwd)) * root).alias("hold_sharpe")
    )
