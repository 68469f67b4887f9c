"""Regression trees over DataFrames: all trees of all training sets grow a level at a time.

A row is ``(*by, i, x, y, w, node)``: ``by`` tells the tree, ``i`` the example, ``x`` the bins of its features, ``y`` an integer target, ``w`` how
often it counts. Rows of weight 0 count for nothing and are led down the trees all the same, so they come out in the leaf that forecasts them.
A level is one aggregation to a row for each tree, node, feature and bin, so its size doesn't depend on how many examples there are, a
running sum over the bins, and one join that moves the rows on. Targets are integers, so sums are exact in any order and ties are true ties;
of equal splits the first feature's first bin is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def training_sets(rows: DataFrame, first: int, step: int, lag: int, window: int | None) -> DataFrame:
    """``rows`` once for each decision row ``s`` of their series that they train (``w`` 1), and once where they are it (``w`` 0).

    Decision rows are those of places ``i`` above ``first``, a ``step`` apart. A row trains those ``lag`` or more after it, so that its target
    is known by then, and within the last ``window`` such rows (all if None).
    """
    i, last = F.col("i"), F.max("i").over(Window.partitionBy("series_id"))
    rows = rows.withColumn("last", last)
    until = F.col("last") if window is None else F.least(F.col("last"), i + lag + window - 1)
    begin = (F.ceil((F.greatest(i + lag, F.lit(first + 1)) - 1) / step) * step + 1).cast("long")
    trains = rows.select("*", F.explode(F.when(begin <= until, F.sequence(begin, until.cast("long"), F.lit(step).cast("long")))).alias("s"), F.lit(1).cast("long").alias("w"))
    decides = rows.where((i > first) & ((i - 1) % step == 0)).select("*", i.cast("long").alias("s"), F.lit(0).cast("long").alias("w"))
    return trains.unionByName(decides).drop("last")


def with_bins(rows: DataFrame, by: list[str], features: str, bins: int) -> DataFrame:
    """``rows`` with ``x``, an array of the bin of each value in the array ``features`` among the training rows (``w`` above 0) of its set: bounds are their values at equal ranks."""
    cells = rows.select(*by, "i", "w", F.posexplode(features).alias("feature", "v"))
    own = [*by, "feature"]
    trained = cells.where("w > 0").withColumns({"rank": F.row_number().over(Window.partitionBy(*own).orderBy("v", "i")), "n": F.count("*").over(Window.partitionBy(*own))})
    bounds = trained.groupBy(*own).agg(F.array(*(F.max(F.when(F.col("rank") == F.expr(f"{k} * n div {bins}"), F.col("v"))) for k in range(1, bins))).alias("bounds"))
    above = F.size(F.filter("bounds", lambda e: F.col("v") > e))
    x = cells.join(bounds, own).groupBy(*by, "i").agg(F.transform(F.sort_array(F.collect_list(F.struct("feature", above.alias("bin")))), lambda c: c["bin"]).alias("x"))
    return rows.join(x, [*by, "i"])


def splits(rows: DataFrame, by: list[str], least: int, only: Column | None = None, chosen: str | None = None) -> DataFrame:
    """The best split ``(feature, bin)`` of each node that has one with ``least`` weight on either side: rows with a bin up to it go left.

    ``only``, of ``by``, ``node`` and ``feature``, is the one bin that may be tried, or null for all; ``chosen`` names an array of the features that may be.
    """
    may = F.col(chosen) if chosen else F.sequence(F.lit(0), F.size("x") - 1)
    cells = rows.where("w > 0").select(*by, "node", "w", (F.col("w") * F.col("y")).alias("wy"), "x", F.explode(may).alias("feature"))
    cells = cells.select(*by, "node", "w", "wy", "feature", F.get("x", F.col("feature")).alias("bin"))
    own = [*by, "node", "feature"]
    cells = cells.groupBy(*own, "bin").agg(F.sum("w").alias("n"), F.sum("wy").alias("t"))
    whole, order = Window.partitionBy(*own), Window.partitionBy(*own).orderBy("bin")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumns({"nl": F.sum("n").over(so_far), "tl": F.sum("t").over(so_far), "all_n": F.sum("n").over(whole), "all_t": F.sum("t").over(whole), "next": F.lead("bin").over(order)})
    nl, nr, tl = F.col("nl").cast("double"), (F.col("all_n") - F.col("nl")).cast("double"), F.col("tl").cast("double")
    tr = (F.col("all_t") - F.col("tl")).cast("double")
    cells = cells.where((nl >= least) & (nr >= least))
    if only is not None:
        cells = cells.where(only.isNull() | ((F.col("bin") <= only) & (F.col("next").isNull() | (F.col("next") > only))))
    cells = cells.withColumn("gain", tl * tl / nl + tr * tr / nr)
    best = F.max_by(F.struct("feature", "bin"), F.struct("gain", -F.col("feature"), -F.col("bin")))
    return cells.groupBy(*by, "node").agg(best.alias("split"))


def grown(rows: DataFrame, by: list[str], depth: int, least: int, only: Column | None = None, chosen: str | None = None) -> DataFrame:
    """``rows`` in the leaves of their trees, told by ``node``: the root is 1, a node's children are twice it and one more."""
    rows = rows.withColumn("node", F.lit(1).cast("long"))
    for level in range(depth):
        found = splits(rows, by, least, only, chosen)
        right = F.get(F.col("x"), F.col("split.feature")) > F.col("split.bin")
        moved = F.when(F.col("split").isNull(), F.col("node")).otherwise(2 * F.col("node") + right.cast("long"))
        rows = rows.join(found, [*by, "node"], "left").withColumn("node", moved).drop("split")
        if level + 1 < depth:
            rows = written(rows, "trees")
    return rows


def with_leaf_means(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with ``mean``, that of their leaf's training rows."""
    leaves = rows.where("w > 0").groupBy(*by, "node").agg((F.sum(F.col("w") * F.col("y")).cast("double") / F.sum("w").cast("double")).alias("mean"))
    return rows.join(leaves, [*by, "node"])


def boosted(rows: DataFrame, by: list[str], rounds: int, rate: float, depth: int, least: int, chosen: str | None = None) -> DataFrame:
    """``*by, i, fit`` of the rows of weight 0: the mean of the training targets and ``rounds`` trees on what is left, each taken at ``rate``.

    What a round explains is rounded to an integer and taken off all targets, those of the rows to forecast beginning at 0.
    """
    rows = rows.withColumn("y", F.when(F.col("w") > 0, F.col("y")).otherwise(0).cast("long"))
    kept = rows.columns
    for k in range(rounds + 1):
        own = grown(rows, by, depth, least, None, chosen) if k else rows.withColumn("node", F.lit(1).cast("long"))
        own = with_leaf_means(own, by)
        left = F.col("y") - F.round((rate if k else 1.0) * F.col("mean")).cast("long")
        rows = written(own.withColumn("y", left).select(*kept), "boosted")
    return rows.where("w = 0").select(*by, "i", (-F.col("y")).cast("double").alias("fit"))
