"""Structured Streaming twins of batch queries, and what runs them to the end of their input."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.folds import HEARTBEAT
from ..sources.scratch import shared_path

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a stream; ``ts`` is a timestamp, as watermarks need."""
    rows = spark.readStream.schema(EVENTS).parquet(f"{sf_dir}/events.parquet*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def run_all(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Run ``stream`` over all input there is into a table in the shared folder, and read that.

    ``append`` writes batches side by side; ``complete`` leaves the last batch's result.
    """
    spark = stream.sparkSession
    path = shared_path(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        # a batch that is tried again replaces what it wrote before
        batch.write.mode("overwrite").parquet(f"{path}/batch={number if mode == 'append' else 0}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", shared_path(spark, "checkpoint")).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/batch=*")


def hourly_bars(events: DataFrame) -> DataFrame:
    """Tumbling hourly bars of each event type; rows later than a day are dropped."""
    order = F.struct("ts", "event_id")
    rows = events.where("value > 0").withWatermark("ts", "1 day")
    bars = rows.groupBy(F.col("event_type").alias("series_id"), F.window("ts", "1 hour")).agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").alias("volume")
    )
    return bars.select("series_id", F.col("window.start").alias("h"), "open", "high", "low", "close", "volume")


HEARTBEATS = "user_id long, slot long, event_id long, ts timestamp, price double, volume long"


def heartbeats(quotes: DataFrame) -> DataFrame:
    """Upserts ``(user_id, slot, ...)`` of the quotes kept: in a closed session an equal quote takes the last one's slot.

    The state of a user is the last quote kept; it is as small as a row however long the stream.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        slot, last_ts, last_price, last_volume = state.get if state.exists else (-1, None, None, None)
        out = []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for event_id, ts, price, volume, is_open in zip(rows["event_id"], rows["ts"], rows["price"], rows["volume"], rows["session_open"], strict=True):
            if slot >= 0 and abs(last_price - price) < 1e-9 and last_volume == volume:
                if is_open:
                    if (ts - last_ts).total_seconds() < HEARTBEAT:
                        continue
                    slot += 1
            else:
                slot += 1
            last_ts, last_price, last_volume = ts, price, volume
            out.append((key[0], slot, event_id, ts, price, volume))
        state.update((slot, last_ts, last_price, last_volume))
        yield pd.DataFrame(out, columns=["user_id", "slot", "event_id", "ts", "price", "volume"])

    state = "slot long, ts timestamp, price double, volume long"
    return quotes.groupBy("user_id").applyInPandasWithState(fold, HEARTBEATS, state, "append", GroupStateTimeout.NoTimeout)


def maturing(events: DataFrame) -> DataFrame:
    """Pairs of a forecast and each price of its user from an hour to 73 hours on: a stream-stream join bounded by watermarks."""
    forecasts = events.where("event_type = 'view'").withWatermark("ts", "1 day")
    forecasts = forecasts.select(F.col("event_id").alias("forecast_id"), F.col("user_id").alias("forecast_user"), F.col("ts").alias("issued_at"), F.col("value").alias("forecast"))
    prices = events.where("event_type = 'click'").withWatermark("ts", "1 day")
    prices = prices.select("user_id", F.col("ts").alias("actual_at"), F.col("value").alias("actual"))
    near = F.expr("forecast_user = user_id AND actual_at >= issued_at + INTERVAL 1 HOUR AND actual_at <= issued_at + INTERVAL 73 HOURS")
    return forecasts.join(prices, near).select("forecast_id", "user_id", "issued_at", "forecast", "actual_at", "actual")


def sessions(events: DataFrame) -> DataFrame:
    """Sessions of each user, ended by six quiet hours."""
    rows = events.withWatermark("ts", "1 day").groupBy("user_id", F.session_window("ts", "6 hours"))
    return rows.agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("began"), F.col("session_window.end").alias("ended"), "n")


def in_order(step, schema: str, kept: str, row: tuple[str, ...]):
    """A grouped state function that gives ``step`` the rows of a key in order of time, each once the watermark has passed it.

    Rows wait in the state until then, and a timer on the earliest wakes the key even if nothing more arrives. ``step(key, past, rows, now)``
    gets its own state ``past`` (None at first), the rows due as tuples of ``row`` (time first, in milliseconds) and the watermark; it returns
    ``(past, out, wake)``: rows of ``schema`` and a time to be woken at, or None. ``kept`` is the names of the output's columns, comma-joined.
    """
    names = kept.split(",")

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, past = json.loads(state.get[0]) if state.exists else ([], None)
        now = state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            for rows in batches:
                waiting += [list(r) for r in rows[list(row)].itertuples(index=False, name=None)]
        waiting.sort()
        due = [tuple(r) for r in waiting if r[0] <= now]
        waiting = waiting[len(due) :]
        past, out, wake = step(key, past, due, now)
        state.update((json.dumps([waiting, past]),))
        times = [t for t in (waiting[0][0] if waiting else None, wake) if t is not None]
        if times:
            state.setTimeoutTimestamp(max(now + 1, min(times)))
        yield pd.DataFrame(out, columns=names)

    return lambda grouped: grouped.applyInPandasWithState(fold, schema, "held string", "append", GroupStateTimeout.EventTimeTimeout)


HOLD_MS = 168 * 3600 * 1000
CALLS = "user_id long, call_id long, stance string, contract long, resolution_ms long, resolution_price double, skipped boolean, realized_pct double, hit boolean"


def _resolve(key, past, rows, now):
    """Calls are open until the first quote 168 hours on; another contract by then skips them, a SHORT is right at no change too."""
    open_, out = past or [], []
    for at, event_id, kind, price, contract, stance in rows:
        if kind == "quote":
            ripe, open_ = [c for c in open_ if c[0] + HOLD_MS <= at], [c for c in open_ if c[0] + HOLD_MS > at]
            for _, call_id, entry, own, side in ripe:
                skipped = own != contract or entry <= 0 or price <= 0
                pct = None if skipped else round((price - entry) / entry * 100, 6)
                out.append((key[0], call_id, side, own, at, price, skipped, pct, None if pct is None or side == "NEUTRAL" else (side == "LONG") == (pct > 0)))
        else:
            open_.append([at, event_id, price, contract, stance])
    return open_, out, None


def resolving(calls_and_quotes: DataFrame) -> DataFrame:
    """Resolved calls of a stream ``user_id, ts, ms, event_id, kind, price, contract, stance``."""
    grouped = calls_and_quotes.withWatermark("ts", "1 day").groupBy("user_id")
    return in_order(_resolve, CALLS, "user_id,call_id,stance,contract,resolution_ms,resolution_price,skipped,realized_pct,hit", ("ms", "event_id", "kind", "price", "contract", "stance"))(grouped)


FRESH_MS, OLDEST_MS = 25 * 60 * 1000, 3 * 3600 * 1000
FEEDS = "user_id long, status string, ms long"


def _feed(key, past, rows, now):
    """A feed is live with a quote, stale 25 minutes after its last one and expired after three hours; changes only."""
    last, status = past or [None, None]
    out = []

    def silent_until(at):
        nonlocal status
        for after, new, old in ((FRESH_MS, "stale", "live"), (OLDEST_MS, "expired", "stale")):
            if last is not None and status == old and last + after < at:
                status = new
                out.append((key[0], new, last + after))

    for at, *_ in rows:
        silent_until(at)
        if status != "live":
            out.append((key[0], "live", at))
        last, status = at, "live"
    silent_until(now + 1)
    wake = None if last is None or status == "expired" else last + (FRESH_MS if status == "live" else OLDEST_MS)
    return [last, status], out, wake


def staleness(quotes: DataFrame) -> DataFrame:
    """Changes of each feed's status in a stream ``user_id, ts, ms, event_id``, those for want of quotes told by timers."""
    grouped = quotes.withWatermark("ts", "1 day").groupBy("user_id")
    return in_order(_feed, FEEDS, "user_id,status,ms", ("ms", "event_id"))(grouped)


def rates(events: DataFrame) -> DataFrame:
    """Requests of each user in the last hour, by sliding windows of a quarter of one."""
    rows = events.withWatermark("ts", "1 day").groupBy("user_id", F.window("ts", "1 hour", "15 minutes"))
    return rows.agg(F.count("*").alias("n")).select("user_id", F.col("window.end").alias("until"), "n")
