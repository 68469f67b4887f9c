"""Statistics that Spark has no function for."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def binomial_tail(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """Probability of ``k`` or more successes of ``n`` at ``p``, summed from the tail; null where an argument is null."""

    def one(k: float, n: float, p: float) -> float | None:
        if pd.isna(k) or pd.isna(n) or pd.isna(p):
            return None
        k, n = int(k), int(n)
        if k <= 0:
            return 1.0
        if p <= 0 or p >= 1:
            return float(p >= 1)
        whole = math.lgamma(n + 1)
        return math.fsum(
            math.exp(whole - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)) for j in range(k, n + 1)
        )

    return pd.Series([one(*x) for x in zip(k, n, p, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def normal_tail(z: pd.Series) -> pd.Series:
    """Probability of a standard normal value above ``z``."""
    return z.map(lambda x: None if pd.isna(x) else 0.5 * math.erfc(x / math.sqrt(2))).astype("float64")


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Ends of the Wilson interval for ``hits`` of ``n``, in percent; null where ``n`` is 0."""
    n = F.when(n > 0, n).cast("double")
    p = hits / n
    middle, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    whole = 1 + z * z / n
    return F.greatest(F.lit(0.0), 100 * (middle - half) / whole), F.least(F.lit(100.0), 100 * (middle + half) / whole)


def r_squared(actual: Column, fitted: Column) -> Column:
    """1 - residual over total sum of squares, as an aggregate; 0 where the total is 0."""
    total = F.var_pop(actual) * F.count(actual)
    return F.when(total > 0, 1 - F.sum((actual - fitted) * (actual - fitted)) / F.when(total > 0, total)).otherwise(0.0)


def round_significant(x: Column, digits: int) -> Column:
    """``x`` rounded to significant digits."""
    size = F.when(x != 0, F.floor(F.log10(F.abs(x)))).otherwise(0)
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - size)
    return F.round(x * scale) / scale
