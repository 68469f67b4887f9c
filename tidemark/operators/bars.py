"""Bars from raw rows, and series derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import series as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily OHLCV bars of each order priority: ``series_id, d, open, high, low, close, volume``."""
    rows = table(spark, sf_dir, "orders").where("o_totalprice > 0")
    return rows.groupBy(F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").cast("date").alias("d")).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"),
        F.max("o_totalprice").alias("high"),
        F.min("o_totalprice").alias("low"),
        F.max_by("o_totalprice", "o_orderkey").alias("close"),
        F.count("*").alias("volume"),
    )


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly OHLCV bars of each event type: ``series_id, h, open, high, low, close, volume``."""
    rows = table(spark, sf_dir, "events").where("value > 0")
    order = F.struct("ts", "event_id")
    return rows.groupBy(F.col("event_type").alias("series_id"), F.window("ts", "1 hour").start.alias("h")).agg(
        F.min_by("value", order).alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", order).alias("close"),
        F.count("*").alias("volume"),
    )


def numbered(bars: DataFrame) -> DataFrame:
    """Bars with their place ``rn`` in the series, from 1."""
    return bars.withColumn("rn", F.row_number().over(S.ordered()).cast("long"))


#: The same bars in SQL, for oracles: common table expressions.
BARS_SQL = """bars AS (
  SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS d, arg_min(o_totalprice, o_orderkey) AS open,
         max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*) AS volume
  FROM orders WHERE o_totalprice > 0 GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY d) AS rn,
             lag(close) OVER (PARTITION BY series_id ORDER BY d) AS pc FROM bars),
r AS (SELECT *, close / pc - 1 AS r, ln(close) - ln(pc) AS lr FROM n)"""
HOURLY_SQL = """hours AS (
  SELECT event_type AS series_id, date_trunc('hour', ts) AS h, arg_min(value, row(ts, event_id)) AS open, max(value) AS high,
         min(value) AS low, arg_max(value, row(ts, event_id)) AS close, count(*) AS volume
  FROM events WHERE value > 0 GROUP BY 1, 2)"""


def frames(*sizes: int) -> str:
    """SQL named windows ``w5, w20, ...`` of the last rows of a series, ``o`` without a frame and ``e`` from its start."""
    by = "PARTITION BY series_id ORDER BY d"
    own = [f"w{n} AS ({by} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in sizes]
    return "WINDOW " + ", ".join([*own, f"o AS ({by})", f"e AS ({by} ROWS UNBOUNDED PRECEDING)"])
