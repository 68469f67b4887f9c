"""Ledgers and chart series: calls, stances, heartbeats, gaps, sampling, arrays."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import series as S
from ..functions.folds import HEARTBEAT, kept_heartbeats
from ..functions.series import r6
from ..operators.asof import asof_join
from ..operators.bars import BARS_SQL, daily_bars, table
from .evaluation import LEDGER_SQL, ledger
from .registry import query

GATE, HOLD_DAYS, RETRACTED = 0.6, 7, "1998-01-01"

CALLS_SQL = f"""{BARS_SQL},
calls AS (SELECT series_id, d, close AS entry_price, strftime(d, '%Y-%m') AS contract, round(100 * (close / lag(close, 5) OVER (PARTITION BY series_id ORDER BY d) - 1), 6) AS forecast_pct, rn % 3 <> 0 AS significant FROM n),
st AS (SELECT *, CASE WHEN significant AND forecast_pct > {GATE} THEN 'LONG' WHEN significant AND forecast_pct < -{GATE} THEN 'SHORT' ELSE 'NEUTRAL' END AS stance FROM calls WHERE forecast_pct IS NOT NULL),
res AS (SELECT st.*, q.d AS resolution_d, q.close AS resolution_price FROM st ASOF LEFT JOIN n q ON st.series_id = q.series_id AND st.d + {HOLD_DAYS} <= q.d),
done AS (SELECT *, resolution_d IS NOT NULL AS resolved, resolution_d IS NOT NULL AND strftime(resolution_d, '%Y-%m') <> contract AS skipped, d < DATE '{RETRACTED}' OR significant AS eligible,
  CASE WHEN resolution_d IS NOT NULL AND strftime(resolution_d, '%Y-%m') = contract THEN round((resolution_price - entry_price) / entry_price * 100, 6) END AS realized_pct FROM res),
scored AS (SELECT *, CASE WHEN stance <> 'NEUTRAL' AND realized_pct IS NOT NULL THEN (stance = 'LONG') = (realized_pct > 0) END AS hit FROM done)"""


def calls(spark, sf_dir):
    """A call for each bar with five bars of history: stance by a strict gate on significant forecasts, contract by month."""
    bars = daily_bars(spark, sf_dir).withColumn("rn", F.row_number().over(S.ordered()))
    pct, sure = F.col("forecast_pct"), F.col("significant")
    stance = F.when(sure & (pct > GATE), "LONG").when(sure & (pct < -GATE), "SHORT").otherwise("NEUTRAL")
    rows = bars.select(
        "series_id", "d", F.col("close").alias("entry_price"), F.date_format("d", "yyyy-MM").alias("contract"), r6(100 * S.pct_change(F.col("close"), 5)).alias("forecast_pct"), (F.col("rn") % 3 != 0).alias("significant")
    )
    return rows.where("forecast_pct IS NOT NULL").withColumn("stance", stance)


def resolved_calls(spark, sf_dir):
    """Calls with the first bar a week or more later; a change of contract skips them, a SHORT is right at no change too."""
    bars = daily_bars(spark, sf_dir).select("series_id", F.col("d").alias("resolution_d"), F.col("close").alias("resolution_price"))
    due = calls(spark, sf_dir).withColumn("due", F.date_add("d", HOLD_DAYS))
    rows = asof_join(due, bars, ["series_id"], "due", "resolution_d", ["resolution_price"], "forward").drop("due")
    known, same = F.col("resolution_d").isNotNull(), F.date_format("resolution_d", "yyyy-MM") == F.col("contract")
    realized = F.when(known & same, r6((F.col("resolution_price") - F.col("entry_price")) / F.col("entry_price") * 100))
    rows = rows.withColumns({"resolved": known, "skipped": known & ~same, "eligible": (F.col("d") < F.to_date(F.lit(RETRACTED))) | F.col("significant"), "realized_pct": realized})
    rows = rows.withColumn("skipped", F.coalesce("skipped", F.lit(False)))
    hit = F.when((F.col("stance") != "NEUTRAL") & F.col("realized_pct").isNotNull(), (F.col("stance") == "LONG") == (F.col("realized_pct") > 0))
    return rows.withColumn("hit", hit)


@query("call_resolution", f"WITH {CALLS_SQL} SELECT series_id, d, contract, stance, forecast_pct, resolution_d, resolved, skipped, realized_pct, hit FROM scored")
def call_resolution(spark, sf_dir):
    return resolved_calls(spark, sf_dir).select("series_id", "d", "contract", "stance", "forecast_pct", "resolution_d", "resolved", "skipped", "realized_pct", "hit")


@query(
    "live_record_summary",
    f"""WITH {CALLS_SQL} SELECT series_id, count(*) AS n_calls, count(*) FILTER (WHERE hit IS NOT NULL AND eligible) AS n_resolved_directional, count(*) FILTER (WHERE hit AND eligible) AS n_hits,
    round(100.0 * count(*) FILTER (WHERE hit AND eligible) / nullif(count(*) FILTER (WHERE hit IS NOT NULL AND eligible), 0), 4) AS hit_rate_pct, count(*) FILTER (WHERE NOT resolved) AS n_pending, count(*) FILTER (WHERE skipped) AS n_skipped_roll,
    count(*) FILTER (WHERE stance = 'NEUTRAL') AS n_neutral, count(*) FILTER (WHERE stance <> 'NEUTRAL' AND NOT eligible) AS n_ineligible_directional, min(d) AS first_call_date FROM scored GROUP BY 1""",
)
def live_record_summary(spark, sf_dir):
    scored = F.col("hit").isNotNull() & F.col("eligible")
    hits, n = F.count_if(F.col("hit") & F.col("eligible")), F.count_if(scored)
    return resolved_calls(spark, sf_dir).groupBy("series_id").agg(
        F.count("*").alias("n_calls"), n.alias("n_resolved_directional"), hits.alias("n_hits"), F.round(100.0 * hits / F.when(n > 0, n), 4).alias("hit_rate_pct"), F.count_if(~F.col("resolved")).alias("n_pending"),
        F.count_if("skipped").alias("n_skipped_roll"), F.count_if(F.col("stance") == "NEUTRAL").alias("n_neutral"), F.count_if((F.col("stance") != "NEUTRAL") & ~F.col("eligible")).alias("n_ineligible_directional"), F.min("d").alias("first_call_date"),
    )


@query(
    "stance_changes",
    f"""WITH {CALLS_SQL}, l AS (SELECT series_id, d, stance, lag(stance) OVER (PARTITION BY series_id ORDER BY d) AS previous FROM st) SELECT series_id, d, previous, stance FROM l WHERE previous IS NULL OR previous <> stance""",
)
def stance_changes(spark, sf_dir):
    rows = calls(spark, sf_dir).withColumn("previous", S.lagged(F.col("stance"), 1))
    return rows.where("previous IS NULL OR previous <> stance").select("series_id", "d", "previous", "stance")


@query(
    "contract_segments",
    f"""WITH {CALLS_SQL}, l AS (SELECT *, CASE WHEN lag(contract) OVER o = contract THEN 0 ELSE 1 END AS new FROM calls WINDOW o AS (PARTITION BY series_id ORDER BY d)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY series_id ORDER BY d ROWS UNBOUNDED PRECEDING) AS segment FROM l)
    SELECT series_id, CAST(segment AS BIGINT) AS segment, any_value(contract) AS contract, min(d) AS first_d, max(d) AS last_d, count(*) AS n FROM s GROUP BY 1, 2""",
)
def contract_segments(spark, sf_dir):
    """Runs of bars under one contract: a change of contract begins a new segment."""
    bars = daily_bars(spark, sf_dir).withColumn("contract", F.date_format("d", "yyyy-MM"))
    new = F.when(S.lagged(F.col("contract"), 1) == F.col("contract"), 0).otherwise(1)
    rows = bars.withColumn("new", new).withColumn("segment", F.sum("new").over(S.past()))
    return rows.groupBy("series_id", "segment").agg(F.first("contract").alias("contract"), F.min("d").alias("first_d"), F.max("d").alias("last_d"), F.count("*").alias("n"))


def session_open(ts):
    """Whether the session is open at a UTC time: Chicago hours, closed on Saturdays, Sundays before 17, Fridays from 16 and from 16 to 17 otherwise."""
    local = F.from_utc_timestamp(ts.cast("timestamp"), "America/Chicago")
    day, hour = F.weekday(local), F.hour(local)
    return F.when(day == 5, False).when(day == 6, hour >= 17).when(day == 4, hour < 16).otherwise(hour != 16)


_LOCAL = "timezone('America/Chicago', timezone('UTC', ts))"
OPEN_SQL = f"CASE isodow({_LOCAL}) WHEN 6 THEN false WHEN 7 THEN hour({_LOCAL}) >= 17 WHEN 5 THEN hour({_LOCAL}) < 16 ELSE hour({_LOCAL}) <> 16 END"


@query("session_filter", f"SELECT event_id, ts, {OPEN_SQL} AS session_open FROM events")
def session_filter(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts", session_open(F.col("ts")).alias("session_open"))


QUOTE_SCHEMA = "user_id long, event_id long, ts timestamp_ntz, price double, volume long"


def quotes(spark, sf_dir):
    """Quotes of each user: values in coarse steps, so that they repeat; the volume comes from ``props``."""
    events = table(spark, sf_dir, "events").where("value > 0")
    volume = F.coalesce(F.get_json_object("props", "$.k").try_cast("long"), F.lit(0)) % 2
    return events.select("user_id", "event_id", "ts", (F.floor(F.col("value") / 40) + 1).cast("double").alias("price"), volume.alias("volume"), session_open(F.col("ts")).alias("session_open"))


@query(
    "heartbeat_dedupe",
    f"""WITH RECURSIVE q AS (SELECT user_id, event_id, ts, floor(value / 40) + 1 AS price, CAST(props ->> '$.k' AS BIGINT) % 2 AS volume, {OPEN_SQL} AS is_open, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE value > 0),
    f AS (SELECT user_id, i, i AS anchor, CAST(NULL AS BIGINT) AS gone FROM q WHERE i = 1 UNION ALL
      SELECT q.user_id, q.i, CASE WHEN NOT same OR NOT q.is_open OR far THEN q.i ELSE f.anchor END, CASE WHEN same AND NOT q.is_open THEN f.anchor END
      FROM f JOIN q ON q.user_id = f.user_id AND q.i = f.i + 1 JOIN q a ON a.user_id = f.user_id AND a.i = f.anchor,
      LATERAL (SELECT a.price = q.price AND a.volume = q.volume AS same, epoch(q.ts) - epoch(a.ts) >= {HEARTBEAT} AS far))
    SELECT q.user_id, q.event_id, q.ts, q.price, q.volume FROM q SEMI JOIN (SELECT DISTINCT user_id, anchor AS i FROM f) k USING (user_id, i) ANTI JOIN (SELECT user_id, gone AS i FROM f WHERE gone IS NOT NULL) g USING (user_id, i)""",
)
def heartbeat_dedupe(spark, sf_dir):
    """Quotes without redundant heartbeats: runs of equal quotes are told by windows, and a fold goes along each run, its state the last quote kept.

    Runs are dealt for themselves, so a user with most of the quotes is spread over tasks.
    """
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    same = (F.abs(F.col("price") - F.lag("price").over(order)) < 1e-9) & (F.col("volume") == F.lag("volume").over(order))
    rows = quotes(spark, sf_dir).withColumn("new", (~F.coalesce(same, F.lit(False))).cast("long"))
    rows = rows.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("new")
    rows = rows.repartition("user_id", "run").sortWithinPartitions("user_id", "run", "ts", "event_id")
    return rows.mapInPandas(kept_heartbeats, QUOTE_SCHEMA)


SPACING, BREAK = 2 * 3600, 12 * 3600
POINTS_SQL = f"""pt AS (SELECT user_id, ts, event_id, value, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_ts FROM events WHERE event_type IN ('view', 'click')),
kept AS (SELECT user_id, ts, event_id, value FROM pt WHERE next_ts IS NULL OR epoch(next_ts) - epoch(ts) > {SPACING})"""


def spaced(spark, sf_dir):
    """Points of each user, those closer than the spacing to the next one replaced by it, link by link."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").where("event_type IN ('view', 'click')").withColumn("next_ts", F.lead("ts").over(order))
    gap = _seconds("next_ts") - _seconds("ts")
    return rows.where(F.col("next_ts").isNull() | (gap > SPACING)).select("user_id", "ts", "event_id", "value")


def _seconds(c):
    return F.unix_micros(F.col(c).cast("timestamp")) / 1e6


@query("spacing_collapse", f"WITH {POINTS_SQL} SELECT * FROM kept")
def spacing_collapse(spark, sf_dir):
    return spaced(spark, sf_dir)


@query(
    "gap_break",
    f"""WITH {POINTS_SQL}, l AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM kept)
    SELECT user_id, epoch_us(ts) AS t, value FROM l UNION ALL SELECT user_id, epoch_us(ts) + (epoch_us(n) - epoch_us(ts)) // 2 AS t, NULL AS value FROM l WHERE epoch(n) - epoch(ts) > {BREAK}""",
)
def gap_break(spark, sf_dir):
    """Points with an empty one halfway through each long gap, in microseconds."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = spaced(spark, sf_dir).withColumn("n", F.lead("ts").over(order))
    point = F.struct(micros("ts").alias("t"), F.col("value"))
    middle = F.when(_seconds("n") - _seconds("ts") > BREAK, F.struct((micros("ts") + F.expr("(unix_micros(cast(n AS timestamp)) - unix_micros(cast(ts AS timestamp))) div 2")).alias("t"), F.lit(None).cast("double").alias("value")))
    return rows.select("user_id", F.explode(F.array_compact(F.array(point, middle))).alias("p")).select("user_id", "p.t", "p.value")


MOST = 200


@query(
    "stride_downsample",
    f"""WITH {BARS_SQL}, c AS (SELECT series_id, d, close, rn, count(*) OVER (PARTITION BY series_id) AS n FROM n),
    p AS (SELECT * FROM c WHERE n <= {MOST} OR (rn - 1) % (n // {MOST}) = 0 OR rn = n), t AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY d DESC) AS back FROM p)
    SELECT series_id, d, close FROM t WHERE back <= {MOST}""",
)
def stride_downsample(spark, sf_dir):
    """Every so-many-th bar and the last one, then the newest ``MOST`` of those."""
    bars = daily_bars(spark, sf_dir).withColumns({"rn": F.row_number().over(S.ordered()), "n": F.count("*").over(Window.partitionBy("series_id"))})
    step = F.greatest(F.lit(1), F.expr(f"cast(n div {MOST} AS int)"))
    some = bars.where((F.col("n") <= MOST) | ((F.col("rn") - 1) % step == 0) | (F.col("rn") == F.col("n")))
    back = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("d")))
    return some.withColumn("back", back).where(F.col("back") <= MOST).select("series_id", "d", "close")


@query(
    "matured_predictions",
    f"""WITH {LEDGER_SQL}, l AS (SELECT user_id, max(actual_at) AS last_at FROM a GROUP BY 1) SELECT event_id, led.user_id, horizon, target, round(pred, 6) AS pred FROM led JOIN l ON l.user_id = led.user_id AND led.target <= last_at""",
)
def matured_predictions(spark, sf_dir):
    """Forecasts whose target time the user's actual prices have reached."""
    last = table(spark, sf_dir, "events").where("event_type = 'click'").groupBy("user_id").agg(F.max("ts").alias("last_at"))
    rows = ledger(spark, sf_dir).join(last, "user_id").where(F.col("target") <= F.col("last_at"))
    return rows.select("event_id", "user_id", "horizon", "target", r6(F.col("pred")).alias("pred"))


@query(
    "chart_arrays",
    """WITH h AS (SELECT user_id, CAST(ts AS DATE) AS day, list(row(ts, event_id, value) ORDER BY ts, event_id) AS p FROM events GROUP BY 1, 2)
    SELECT user_id, day, len(p) AS n, array_to_string(list_transform(p, lambda x: CAST(epoch_us(x[1]) AS VARCHAR)), ',') AS timestamps, array_to_string(list_transform(p, lambda x: CAST(CAST(round(x[3] * 100) AS BIGINT) AS VARCHAR)), ',') AS cents FROM h""",
)
def chart_arrays(spark, sf_dir):
    """Points of a user's day as parallel arrays in order of time, joined to text; a day's array is what a chart shows at once."""
    point = F.struct("ts", "event_id", "value")
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.array_sort(F.collect_list(point)).alias("p"))
    stamps = F.transform("p", lambda x: F.unix_micros(x["ts"].cast("timestamp")).cast("string"))
    cents = F.transform("p", lambda x: F.round(x["value"] * 100).cast("long").cast("string"))
    return rows.select("user_id", "day", F.size("p").cast("long").alias("n"), F.array_join(stamps, ",").alias("timestamps"), F.array_join(cents, ",").alias("cents"))


@query(
    "request_rate",
    """SELECT event_id, user_id, ts, count(*) OVER w AS in_window, count(*) OVER w > 3 AS limited FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 21600 PRECEDING AND CURRENT ROW)""",
)
def request_rate(spark, sf_dir):
    """How many events a user had in the six hours up to each one, and whether that is over the limit."""
    seconds = F.expr("cast(round(unix_micros(cast(ts AS timestamp)) / 1e6) AS long)")
    w = Window.partitionBy("user_id").orderBy(seconds).rangeBetween(-21600, 0)
    n = F.count("*").over(w)
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", n.alias("in_window"), (n > 3).alias("limited"))
