"""As-of joins by union and fill: one sort by key and time instead of a product of the sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    left_time: str,
    right_time: str,
    values: list[str],
    direction: str = "backward",
    within: Column | None = None,
) -> DataFrame:
    """``left`` with ``values`` and ``right_time`` of the nearest row of ``right`` with equal ``by``, null where there is none.

    ``backward`` takes the latest right row at or before ``left_time``, ``forward`` the first at or after it. Times that are equal match.
    ``within`` is a condition on the joined row (such as a tolerance); where it fails the right side is null. Rows of ``right``
    with a null time are ignored; of several at one time any may match, so make them unique first.
    """
    side, order = "_side", "_at"
    picked = F.struct(F.col(right_time), *(F.col(v) for v in values))
    own = left.select(F.struct(*left.columns).alias("_row"), *by, F.col(left_time).alias(order), F.lit(None).cast(right.select(picked.alias("v")).schema["v"].dataType).alias("_hit"))
    other = right.where(F.col(right_time).isNotNull()).select(*by, F.col(right_time).alias(order), picked.alias("_hit"))
    back = direction == "backward"
    both = own.withColumn(side, F.lit(int(back))).unionByName(other.withColumn(side, F.lit(int(not back))), allowMissingColumns=True)
    frame = Window.partitionBy(*by).orderBy(order, side)
    if back:
        hit = F.last("_hit", ignorenulls=True).over(frame.rowsBetween(Window.unboundedPreceding, 0))
    else:
        # the same fill, read backwards: the next right row is the last one in descending order
        down = Window.partitionBy(*by).orderBy(F.col(order).desc(), F.col(side).desc())
        hit = F.last("_hit", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("_hit", hit).where(F.col("_row").isNotNull()).select("_row.*", F.col(f"_hit.{right_time}").alias(right_time), *(F.col(f"_hit.{v}").alias(v) for v in values))
    if within is None:
        return found
    return found.withColumns({c: F.when(within, F.col(c)) for c in [right_time, *values]})
