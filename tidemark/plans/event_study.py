"""Price response around dated shocks, and their grouped distributions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.asof import asof_join
from ..operators.bars import BARS_SQL, daily_bars, numbered
from .registry import query

# Dated shocks on the synthetic calendar: id, date, type, drivers, supply lost, whether a strait is at risk.
SHOCKS = [
    ("s01", "1995-03-14", "disruption", "conflict,iran", 1.2, True),
    ("s02", "1995-09-02", "weather", "weather", 0.8, False),
    ("s03", "1996-02-20", "policy", "opec", 1.5, False),
    ("s04", "1996-11-11", "threat", "iran,sanctions", 0.0, True),
    ("s05", "1997-06-05", "threat", "conflict", 0.0, False),
    ("s06", "1998-01-19", "policy", "opec", 2.0, False),
    ("s07", "1998-08-27", "weather", "weather", 0.4, False),
    ("s08", "1999-04-08", "disruption", "sanctions", 0.7, False),
    ("s09", "1999-12-30", "threat", "iran", 0.0, True),
    ("s10", "2000-07-17", "disruption", "conflict,opec", 0.9, False),
    ("s11", "2001-02-02", "policy", "opec,sanctions", 0.0, False),
    ("s12", "2003-01-01", "disruption", "conflict", 1.0, True),
]
BEFORE, AFTER, SETTLE = 5, 20, 10
OFFSETS = (0, 1, 2, 3, 5, 10, 15)


def shocks(spark):
    rows = spark.createDataFrame(SHOCKS, "id string, date string, type string, drivers string, supply double, strait boolean")
    return rows.select("id", F.to_date("date").alias("event_d"), "type", F.split("drivers", ",").alias("drivers"), "supply", "strait")


_VALUES = ", ".join(f"('{i}', DATE '{d}', '{t}', {k.split(',')!r}, {s}::DOUBLE, {str(x).lower()})" for i, d, t, k, s, x in SHOCKS)
RESPONSE_SQL = f"""{BARS_SQL}, sh(id, event_d, type, drivers, supply, strait) AS (VALUES {_VALUES}),
lastrow AS (SELECT series_id, max(rn) AS last_rn FROM n GROUP BY 1),
ats AS (SELECT sh.*, n.series_id, min(rn) AS i FROM sh JOIN n ON n.d >= sh.event_d GROUP BY ALL),
base AS (SELECT ats.id, ats.series_id, avg(close) AS base FROM ats JOIN n ON n.series_id = ats.series_id AND n.rn >= ats.i - {BEFORE} AND n.rn < ats.i GROUP BY 1, 2),
fwd AS (SELECT ats.id, ats.series_id, n.rn - ats.i AS k, n.d, n.close FROM ats JOIN n ON n.series_id = ats.series_id AND n.rn >= ats.i AND n.rn < ats.i + {AFTER}),
ext AS (SELECT id, series_id, max(close) AS peak, min(close) AS trough, arg_max(d, row(close, -k)) AS peak_d, min(d) AS first_d, max(CASE WHEN k = 0 THEN close END) AS day0 FROM fwd GROUP BY 1, 2),
resp AS (SELECT ats.*, coalesce(base.base, day0) AS base, peak, trough, date_diff('day', first_d, peak_d) AS peak_day, day0, st.close AS settle FROM ats JOIN ext USING (id, series_id) LEFT JOIN base USING (id, series_id)
  JOIN lastrow USING (series_id) JOIN n st ON st.series_id = ats.series_id AND st.rn = least(ats.i + {SETTLE}, last_rn))"""


def responses(spark, sf_dir):
    """Response of each series to each shock, by place in the series: base of the five bars before, extremes of twenty bars, the eleventh bar.

    A shock is matched to its first bar by a forward as-of join and meets bars by an equi-join on their places, so nothing but its own window is joined.
    """
    bars = numbered(daily_bars(spark, sf_dir)).select("series_id", "d", "rn", "close")
    ends = bars.groupBy("series_id").agg(F.max("rn").alias("last_rn"))
    events = ends.select("series_id").join(F.broadcast(shocks(spark)))
    first = asof_join(events, bars.withColumnRenamed("d", "bar_d"), ["series_id"], "event_d", "bar_d", ["rn"], "forward").where("rn IS NOT NULL")
    spans = F.explode(F.sequence(F.lit(-BEFORE), F.lit(AFTER - 1))).alias("k")
    window = first.select("series_id", "id", F.col("rn").alias("i"), spans).join(ends, "series_id")
    window = window.withColumn("rn", F.col("i") + F.col("k")).join(bars, ["series_id", "rn"])
    k, c = F.col("k"), F.col("close")
    fwd = lambda x: F.when(k >= 0, x)
    ext = window.groupBy("series_id", "id").agg(
        F.avg(F.when(k < 0, c)).alias("prior"), F.max(fwd(c)).alias("peak"), F.min(fwd(c)).alias("trough"), F.max_by(fwd(F.col("d")), fwd(F.struct(c, -k))).alias("peak_d"), F.min(fwd(F.col("d"))).alias("first_d"),
        F.max(F.when(k == 0, c)).alias("day0"), F.max(F.when(k == F.least(F.lit(SETTLE), F.col("last_rn") - F.col("i")), c)).alias("settle"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(k.isin(*OFFSETS), F.struct(k.alias("k"), c.alias("close")))))).alias("path"),
    )
    out = first.drop("bar_d", "rn").join(ext, ["series_id", "id"])
    return out.withColumns({"base": F.coalesce("prior", "day0"), "peak_day": F.datediff("peak_d", "first_d").cast("long")})


def _pct(x):
    return F.round(F.try_divide(F.col(x) - F.col("base"), F.col("base")) * 100, 4)


@query(
    "event_window_response",
    f"""WITH {RESPONSE_SQL} SELECT series_id, id, round(base, 2) AS base, round((peak - base) / nullif(base, 0) * 100, 4) AS peak_pct, peak_day, round((trough - base) / nullif(base, 0) * 100, 4) AS trough_pct,
    round((settle - base) / nullif(base, 0) * 100, 4) AS settle_pct, round((day0 - base) / nullif(base, 0) * 100, 4) AS day0_pct FROM resp""",
)
def event_window_response(spark, sf_dir):
    rows = responses(spark, sf_dir)
    return rows.select("series_id", "id", F.round("base", 2).alias("base"), _pct("peak").alias("peak_pct"), "peak_day", _pct("trough").alias("trough_pct"), _pct("settle").alias("settle_pct"), _pct("day0").alias("day0_pct"))


@query(
    "event_trajectory",
    f"""WITH {RESPONSE_SQL} SELECT resp.series_id, resp.id, CAST(k AS INTEGER) AS k, round((close - base) / nullif(base, 0) * 100, 4) AS move_pct FROM resp JOIN fwd USING (series_id, id) WHERE k IN {OFFSETS}""",
)
def event_trajectory(spark, sf_dir):
    """The move since the base after 0 to 15 bars, from the map a response keeps."""
    rows = responses(spark, sf_dir).select("series_id", "id", "base", F.explode("path").alias("k", "close"))
    return rows.select("series_id", "id", "k", F.round(F.try_divide(F.col("close") - F.col("base"), F.col("base")) * 100, 4).alias("move_pct"))


#: Groups a shock can be in, several at once: name, condition in SQL that both engines read alike.
GROUPS = {
    "supply_lost": "supply > 0.5", "threat_only": "supply = 0", "strait_risk": "strait", "iran_driven": "array_contains(drivers, 'iran')", "opec_cut": "array_contains(drivers, 'opec') AND supply > 0",
    "weather": "array_contains(drivers, 'weather')", "conflict": "array_contains(drivers, 'conflict')", "sanctions": "array_contains(drivers, 'sanctions')",
}


@query(
    "event_group_distribution",
    f"""WITH {RESPONSE_SQL}, g AS (SELECT *, unnest(list_filter([{', '.join(f"CASE WHEN {c} THEN '{g}' END" for g, c in GROUPS.items())}], lambda x: x IS NOT NULL)) AS category FROM resp),
    p AS (SELECT series_id, category, (peak - base) / nullif(base, 0) * 100 AS peak_pct, (settle - base) / nullif(base, 0) * 100 AS settle_pct FROM g)
    SELECT series_id, category, count(*) AS n, round(quantile_cont(peak_pct, 0.5), 4) AS median_peak, round(min(peak_pct), 4) AS min_peak, round(max(peak_pct), 4) AS max_peak, round(quantile_cont(settle_pct, 0.5), 4) AS median_settle FROM p GROUP BY 1, 2""",
)
def event_group_distribution(spark, sf_dir):
    """Distributions over groups that overlap: a shock counts in each group whose condition it meets."""
    labels = F.array_compact(F.array(*(F.when(F.expr(c), g) for g, c in GROUPS.items())))
    move = lambda x: F.try_divide(F.col(x) - F.col("base"), F.col("base")) * 100
    rows = responses(spark, sf_dir).select("series_id", F.explode(labels).alias("category"), move("peak").alias("peak_pct"), move("settle").alias("settle_pct"))
    return rows.groupBy("series_id", "category").agg(
        F.count("*").alias("n"), F.round(F.percentile("peak_pct", 0.5), 4).alias("median_peak"), F.round(F.min("peak_pct"), 4).alias("min_peak"), F.round(F.max("peak_pct"), 4).alias("max_peak"),
        F.round(F.percentile("settle_pct", 0.5), 4).alias("median_settle"),
    )


@query(
    "event_priced_in",
    f"""WITH {RESPONSE_SQL}, p AS (SELECT series_id, (day0 - base) / nullif(base, 0) * 100 AS d0, (peak - base) / nullif(base, 0) * 100 AS pk FROM resp)
    SELECT series_id, count(*) FILTER (WHERE d0 >= 3) AS strong_day0_n, round(quantile_cont(pk, 0.5) FILTER (WHERE d0 >= 3), 4) AS strong_day0_median_peak,
    count(*) FILTER (WHERE d0 < 3) AS weak_day0_n, round(quantile_cont(pk, 0.5) FILTER (WHERE d0 < 3), 4) AS weak_day0_median_peak FROM p GROUP BY 1""",
)
def event_priced_in(spark, sf_dir):
    move = lambda x: F.try_divide(F.col(x) - F.col("base"), F.col("base")) * 100
    strong, peak = move("day0") >= 3, move("peak")
    return responses(spark, sf_dir).groupBy("series_id").agg(
        F.count_if(strong).alias("strong_day0_n"), F.round(F.percentile(F.when(strong, peak), 0.5), 4).alias("strong_day0_median_peak"),
        F.count_if(~strong).alias("weak_day0_n"), F.round(F.percentile(F.when(~strong, peak), 0.5), 4).alias("weak_day0_median_peak"),
    )


@query(
    "event_top_analogues",
    f"""WITH {RESPONSE_SQL}, s AS (SELECT *, len(list_intersect(drivers, ['iran', 'conflict'])) AS overlap FROM resp),
    rk AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY overlap * 1000 + year(event_d) DESC, id) AS place FROM s)
    SELECT series_id, CAST(place AS INTEGER) AS place, id, CAST(overlap AS INTEGER) AS overlap, round((peak - base) / nullif(base, 0) * 100, 4) AS peak_pct FROM rk WHERE place <= 5""",
)
def event_top_analogues(spark, sf_dir):
    """The five shocks most like the present drivers, the later first among equals."""
    overlap = F.size(F.array_intersect("drivers", F.array(F.lit("iran"), F.lit("conflict"))))
    best = Window.partitionBy("series_id").orderBy(F.desc(overlap * 1000 + F.year("event_d")), "id")
    rows = responses(spark, sf_dir).withColumn("place", F.row_number().over(best)).where("place <= 5")
    return rows.select("series_id", "place", "id", overlap.alias("overlap"), _pct("peak").alias("peak_pct"))


