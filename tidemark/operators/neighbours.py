"""Mutual information by nearest neighbours, exact, from windows over ranks.

Of a sample of pairs (x, y), a point's distance to its k-th neighbour (the larger of both coordinates' gaps) says how dense the sample is there,
and how many points lie nearer in x alone and in y alone says how much of that each coordinate explains.

The k-th neighbour is looked for among the points next in rank by x. What is farther in rank is at least as far as the last of those, so the
distance found is exact once that gap is no smaller; points for which it isn't look again among four times as many. Counts of nearer points
are differences of ranks, found by sorting the bounds into the sample. Coordinates are integers, so gaps and ties are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

UNIT = 10**9  # of a standard deviation


def digamma(n: Column) -> Column:
    """The digamma function of a positive number: shifted up by six, then its asymptotic series."""
    z = n + 6.0
    series = F.ln(z) - 1 / (2 * z) - 1 / (12 * z * z) + 1 / (120 * z * z * z * z) - 1 / (252 * z * z * z * z * z * z)
    return series - sum((1 / (n + float(j)) for j in range(1, 6)), 1 / n)


def scaled(x: str, by: list[str]) -> Column:
    """``x`` in integers, by its standard deviation in its group; 0 where it doesn't vary."""
    std = F.stddev_pop(x).over(Window.partitionBy(*by))
    return F.coalesce(F.round(F.col(x) / F.when(std > 0, std) * UNIT), F.lit(0.0)).cast("long")


def kth_distances(points: DataFrame, by: list[str], k: int, reach: int = 48) -> DataFrame:
    """``points(*by, id, x, y)`` with ``radius``, the distance to the k-th nearest other point; null in groups of ``k`` points or fewer."""
    group, order = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("x", "id")
    ranked = written(points.withColumns({"rank": F.row_number().over(order), "size": F.count("*").over(group)}), "points")
    most = ranked.agg(F.max("size")).first()[0] or 0
    out, asked = ranked.where(F.col("size") <= k).withColumn("radius", F.lit(None).cast("long")), None
    while True:
        near = order.rowsBetween(-reach, reach)
        x, y = F.col("x"), F.col("y")
        seen = ranked.withColumn("near", F.collect_list(F.struct("x", "y")).over(near)) if asked is None else ranked.join(asked, [*by, "id"], "left").withColumn("near", F.when(F.col("wanted"), F.collect_list(F.struct("x", "y")).over(near)))
        seen = seen.where((F.col("size") > k) & (F.lit(True) if asked is None else F.col("wanted")))
        gaps = F.sort_array(F.transform("near", lambda p: F.greatest(F.abs(p["x"] - x), F.abs(p["y"] - y))))
        low, high = F.element_at("near", 1)["x"], F.element_at("near", -1)["x"]
        seen = seen.withColumns({"radius": F.get(gaps, F.lit(k)), "low": low, "high": high})
        known = ((F.col("rank") - reach <= 1) | (x - F.col("low") >= F.col("radius"))) & ((F.col("rank") + reach >= F.col("size")) | (F.col("high") - x >= F.col("radius")))
        seen = written(seen.withColumn("known", F.coalesce(known, F.lit(False))).select(*by, "id", "x", "y", "rank", "size", "radius", "known"), "near")
        out = out.unionByName(seen.where("known").drop("known"))
        if reach >= most or seen.where("NOT known").isEmpty():
            return out.drop("rank", "size")
        asked = seen.where("NOT known").select(*by, "id", F.lit(True).alias("wanted"))
        reach *= 4


def nearer(points: DataFrame, by: list[str], c: str) -> DataFrame:
    """``*by, id, n``: how many points of the group, the point itself included, are nearer than ``radius`` in coordinate ``c``; 1 at least."""
    value, r = F.col(c), F.col("radius")
    bounds = F.array(F.struct((value - r).alias("at"), F.lit(1).alias("side")), F.struct((value + r).alias("at"), F.lit(-1).alias("side")))
    probes = points.where("radius IS NOT NULL").select(*by, "id", F.explode(bounds).alias("b")).select(*by, "id", "b.at", "b.side")
    own = points.select(*by, F.lit(None).cast("long").alias("id"), value.alias("at"), F.lit(0).alias("side"))
    # at equal values: an upper bound comes before the points, a lower one after them, so both leave out what is exactly at the radius
    line = Window.partitionBy(*by).orderBy("at", F.col("side"), "id").rowsBetween(Window.unboundedPreceding, 0)
    counted = own.unionByName(probes).withColumn("below", F.sum((F.col("side") == 0).cast("long")).over(line)).where("side <> 0")
    return counted.groupBy(*by, "id").agg(F.greatest(F.lit(1), F.sum(-F.col("side") * F.col("below"))).alias("n"))


def mutual_information(points: DataFrame, by: list[str], k: int = 3) -> DataFrame:
    """``*by, mi`` of ``points(*by, id, x, y)`` with integer coordinates, ids unique in a group; 0 at least, and in groups of ``k`` points or fewer."""
    found = written(kth_distances(points, by, k), "radii")
    counts = nearer(found, by, "x").withColumnRenamed("n", "nx").join(nearer(found, by, "y").withColumnRenamed("n", "ny"), [*by, "id"])
    means = counts.groupBy(*by).agg(F.count("*").alias("n"), F.avg(digamma(F.col("nx").cast("double"))).alias("px"), F.avg(digamma(F.col("ny").cast("double"))).alias("py"))
    mi = F.greatest(F.lit(0.0), digamma(F.col("n").cast("double")) + digamma(F.lit(float(k))) - F.col("px") - F.col("py"))
    return points.select(*by).distinct().join(means.select(*by, mi.alias("mi")), by, "left").fillna(0.0, ["mi"])
