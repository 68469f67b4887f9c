"""Column functions over one series at a time. Frames end at the current row unless a name says otherwise."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

KEY, TIME = "series_id", "d"
TINY = 1e-9


def past(n: int | None = None, key: str = KEY, time: str = TIME) -> WindowSpec:
    """The last ``n`` rows of a series, the current one included; all rows so far if ``n`` is None."""
    return Window.partitionBy(key).orderBy(time).rowsBetween(Window.unboundedPreceding if n is None else 1 - n, 0)


def ordered(key: str = KEY, time: str = TIME) -> WindowSpec:
    """Rows of a series in order of time, without a frame."""
    return Window.partitionBy(key).orderBy(time)


def finite(x: Column) -> Column:
    """``x``, or null where it is NaN or infinite."""
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)


def ratio(a: Column, b: Column, default: float | None = 0.0) -> Column:
    """``a / b``, or ``default`` where ``b`` is null or next to zero."""
    safe = F.when(F.abs(b) >= TINY, b)
    return F.coalesce(a / safe, F.lit(default)) if default is not None else a / safe


def lagged(x: Column, n: int) -> Column:
    return F.lag(x, n).over(ordered())


def pct_change(x: Column, n: int, default: float | None = None) -> Column:
    """Relative change against ``n`` rows before."""
    return ratio(x - lagged(x, n), lagged(x, n), default)


def log_return(x: Column) -> Column:
    return F.ln(x) - F.ln(lagged(x, 1))


def full(x: Column, agg: Column, n: int) -> Column:
    """A rolling aggregate of ``x`` that needs ``n`` values: null until there are as many."""
    return F.when(F.count(x).over(past(n)) == n, agg.over(past(n)))


def rolling_zscore(x: Column, n: int) -> Column:
    std = full(x, F.stddev_samp(x), n)
    return (x - full(x, F.avg(x), n)) / F.when(std > 0, std)


def tail_zscore(x: Column, n: int) -> Column:
    """Z-score in a partial window of at least three rows; 0 where it is flat or shorter."""
    w, std = past(max(3, n)), F.stddev_samp(x).over(past(max(3, n)))
    return F.when((F.count(x).over(w) >= 3) & (std >= TINY), (x - F.avg(x).over(w)) / std).otherwise(0.0)


def log_slope(x: Column, n: int, row: Column) -> Column:
    """Least-squares slope of ``ln(x)`` per row over the last ``n`` rows with positive values; 0 with fewer than three."""
    w, good = past(n), F.when(x > 0, F.ln(x))
    return F.when(F.count(good).over(w) >= 3, F.regr_slope(good, row).over(w)).otherwise(0.0)


def skewness_g1(x: Column, w: WindowSpec) -> Column:
    """Bias-corrected skewness; 0 with fewer than three values or a flat window."""
    n = F.count(x).over(w).cast("double")
    usable = (n >= 3) & (F.stddev_pop(x).over(w) >= 1e-12)
    return F.when(usable, F.skewness(x).over(w) * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2)).otherwise(0.0)


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def r2(x: Column) -> Column:
    return F.round(x, 2)


def r6(x: Column) -> Column:
    return F.round(x, 6)


def sign(x: Column) -> Column:
    return F.signum(x).cast("int")
