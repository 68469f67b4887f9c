"""Streaming queries, checked against the SQL of their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.bars import HOURLY_SQL
from ..sources.sinks import latest
from ..streaming import streams
from .ledgers import session_open
from .registry import ORACLES, query


def _naive(c):
    return F.col(c).cast("timestamp_ntz").alias(c)


@query("stream_bars_hourly", f"WITH {HOURLY_SQL} SELECT series_id, h, open, high, low, close, volume FROM hours")
def stream_bars_hourly(spark, sf_dir):
    bars = streams.run_all(streams.hourly_bars(streams.event_stream(spark, sf_dir)), "complete", "bars")
    return bars.select("series_id", _naive("h"), "open", "high", "low", "close", "volume")


@query("stream_heartbeat_dedupe", ORACLES["heartbeat_dedupe"])
def stream_heartbeat_dedupe(spark, sf_dir):
    events = streams.event_stream(spark, sf_dir).where("value > 0")
    volume = F.coalesce(F.get_json_object("props", "$.k").try_cast("long"), F.lit(0)) % 2
    quotes = events.select("user_id", "event_id", "ts", (F.floor(F.col("value") / 40) + 1).cast("double").alias("price"), volume.alias("volume"), session_open(F.col("ts")).alias("session_open"))
    log = streams.run_all(streams.heartbeats(quotes), "append", "heartbeats")
    return latest(log, ["user_id", "slot"], ["ts", "event_id"]).select("user_id", "event_id", _naive("ts"), "price", "volume")


@query(
    "stream_forecast_maturation",
    """SELECT f.event_id, f.user_id, min(a.ts) AS actual_at, arg_min(a.value, row(a.ts, -a.value)) AS actual FROM events f JOIN events a ON f.event_type = 'view' AND a.event_type = 'click' AND a.user_id = f.user_id
    AND a.ts >= f.ts + INTERVAL 1 HOUR AND a.ts <= f.ts + INTERVAL 73 HOUR GROUP BY 1, 2""",
)
def stream_forecast_maturation(spark, sf_dir):
    pairs = streams.run_all(streams.maturing(streams.event_stream(spark, sf_dir)), "append", "matured")
    first = pairs.groupBy(F.col("forecast_id").alias("event_id"), "user_id")
    return first.agg(F.min("actual_at").cast("timestamp_ntz").alias("actual_at"), F.min_by("actual", F.struct("actual_at", -F.col("actual"))).alias("actual"))


@query(
    "stream_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) < 21600 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS began, max(ts) + INTERVAL 6 HOUR AS ended, count(*) AS n FROM s GROUP BY user_id, s""",
)
def stream_sessions(spark, sf_dir):
    rows = streams.run_all(streams.sessions(streams.event_stream(spark, sf_dir)), "complete", "sessions")
    return rows.select("user_id", _naive("began"), _naive("ended"), "n")


_MS = "CAST(floor(epoch_us(ts) / 1000) AS BIGINT)"


def _known_sql(rows):
    """The stream's rows and how far its watermark comes."""
    return f"ev AS (SELECT *, {_MS} AS ms FROM events WHERE {rows}), wm AS (SELECT max(ms) - 86400000 AS w FROM ev)"


def _milliseconds():
    return F.floor(F.unix_micros("ts") / 1000).cast("long")


@query(
    "stream_call_resolution",
    f"""WITH {_known_sql("event_type IN ('view', 'click')")}, c AS (SELECT user_id, event_id AS call_id, ms, value AS entry, (day(ts) - 1) // 10 AS contract, CASE WHEN event_id % 3 = 0 THEN 'NEUTRAL' WHEN event_id % 3 = 1 THEN 'LONG' ELSE 'SHORT' END AS stance FROM ev WHERE event_type = 'view'),
    q AS (SELECT user_id, ms, event_id, value AS price, (day(ts) - 1) // 10 AS contract FROM ev, wm WHERE event_type = 'click' AND ms <= w),
    f AS (SELECT c.*, q.ms AS resolution_ms, q.price, q.contract AS current, row_number() OVER (PARTITION BY call_id ORDER BY q.ms, q.event_id) AS k FROM c JOIN q ON q.user_id = c.user_id AND q.ms >= c.ms + 604800000),
    s AS (SELECT *, contract <> current OR entry <= 0 OR price <= 0 AS skipped FROM f WHERE k = 1), p AS (SELECT *, CASE WHEN NOT skipped THEN round((price - entry) / entry * 100, 6) END AS pct FROM s)
    SELECT user_id, call_id, stance, contract, resolution_ms, price AS resolution_price, skipped, pct AS realized_pct, CASE WHEN pct IS NOT NULL AND stance <> 'NEUTRAL' THEN (stance = 'LONG') = (pct > 0) END AS hit FROM p""",
)
def stream_call_resolution(spark, sf_dir):
    """Calls of a stream of views, resolved by the first click price 168 hours on, as far as the watermark has come."""
    events = streams.event_stream(spark, sf_dir).where("event_type IN ('view', 'click')")
    stance = F.when(F.col("event_id") % 3 == 0, "NEUTRAL").when(F.col("event_id") % 3 == 1, "LONG").otherwise("SHORT")
    kind, contract = F.when(F.col("event_type") == "click", "quote").otherwise("view"), F.floor((F.dayofmonth("ts") - 1) / 10).cast("long")
    rows = events.select("user_id", "ts", _milliseconds().alias("ms"), "event_id", kind.alias("kind"), F.col("value").alias("price"), contract.alias("contract"), stance.alias("stance"))
    return streams.run_all(streams.resolving(rows), "append", "calls").select(
        "user_id", "call_id", "stance", "contract", "resolution_ms", "resolution_price", "skipped", "realized_pct", "hit"
    )


@query(
    "stream_staleness",
    f"""WITH {_known_sql('value > 0')}, q AS (SELECT user_id, ms, lag(ms) OVER o AS before, lead(ms) OVER o AS next FROM ev WHERE value > 0 WINDOW o AS (PARTITION BY user_id ORDER BY ms, event_id)),
    c AS (SELECT user_id, 'live' AS status, ms FROM q WHERE before IS NULL OR ms > before + {streams.FRESH_MS} UNION ALL SELECT user_id, 'stale', ms + {streams.FRESH_MS} FROM q WHERE next IS NULL OR next > ms + {streams.FRESH_MS}
      UNION ALL SELECT user_id, 'expired', ms + {streams.OLDEST_MS} FROM q WHERE next IS NULL OR next > ms + {streams.OLDEST_MS}) SELECT user_id, status, ms FROM c, wm WHERE ms <= w""",
)
def stream_staleness(spark, sf_dir):
    """When each user's feed went live, stale and expired, as far as the watermark has come."""
    rows = streams.event_stream(spark, sf_dir).where("value > 0").select("user_id", "ts", _milliseconds().alias("ms"), "event_id")
    return streams.run_all(streams.staleness(rows), "append", "feeds").select("user_id", "status", "ms")


@query(
    "stream_request_rate",
    """WITH w AS (SELECT user_id, unnest(generate_series(0, 3)) AS k, ts FROM events) SELECT user_id, time_bucket(INTERVAL 15 MINUTE, ts) + to_minutes(CAST(15 * (k + 1) AS INTEGER)) AS until, count(*) AS n FROM w GROUP BY 1, 2""",
)
def stream_request_rate(spark, sf_dir):
    """Requests of each user by sliding hours."""
    rows = streams.run_all(streams.rates(streams.event_stream(spark, sf_dir)), "complete", "rates")
    return rows.select("user_id", _naive("until"), "n")
