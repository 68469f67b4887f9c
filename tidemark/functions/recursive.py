"""Recursions over the ordered values of a window: exponential means and Wilder's relative strength.

They restart at the first value of the array, so the array must be the window's.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def macd(xs: Column, fast: int = 12, slow: int = 26, signal: int = 9) -> Column:
    """Exponential means of spans ``fast`` and ``slow``, that of their difference, and the gap to it one step before."""
    a, b, c = 2 / (fast + 1), 2 / (slow + 1), 2 / (signal + 1)
    first = F.coalesce(F.get(xs, F.lit(0)), F.lit(0.0))
    start = F.struct(first.alias("fast"), first.alias("slow"), F.lit(0.0).alias("signal"), F.lit(0.0).alias("gap_before"))

    def step(s: Column, x: Column) -> Column:
        quick, lazy = s["fast"] + a * (x - s["fast"]), s["slow"] + b * (x - s["slow"])
        return F.struct(
            quick.alias("fast"),
            lazy.alias("slow"),
            (s["signal"] + c * (quick - lazy - s["signal"])).alias("signal"),
            (s["fast"] - s["slow"] - s["signal"]).alias("gap_before"),
        )

    return F.aggregate(F.slice(xs, 2, 1 << 30), start, step)


def rsi(xs: Column, n: int = 14) -> Column:
    """Wilder's relative strength index; 50 with fewer than ``n`` + 1 values and 100 without any loss."""
    moves = F.zip_with(F.slice(xs, 2, 1 << 30), F.slice(xs, 1, F.greatest(F.size(xs) - 1, F.lit(0))), lambda x, y: x - y)
    gains, losses = F.transform(moves, lambda m: F.greatest(m, F.lit(0.0))), F.transform(moves, lambda m: F.greatest(-m, F.lit(0.0)))
    mean = lambda v: F.aggregate(F.slice(v, 1, n), F.lit(0.0), lambda a, x: a + x) / n
    start = F.struct(mean(gains).alias("g"), mean(losses).alias("l"))

    def step(s: Column, m: Column) -> Column:
        gain, loss = F.greatest(m, F.lit(0.0)), F.greatest(-m, F.lit(0.0))
        return F.struct(((s["g"] * (n - 1) + gain) / n).alias("g"), ((s["l"] * (n - 1) + loss) / n).alias("l"))

    def value(s: Column) -> Column:
        return F.when(s["l"] == 0, 100.0).otherwise(100 - 100 / (1 + s["g"] / F.when(s["l"] != 0, s["l"])))

    return F.when(F.size(xs) < n + 1, 50.0).otherwise(F.aggregate(F.slice(moves, n + 1, 1 << 30), start, step, value))
