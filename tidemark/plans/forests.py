"""A walk-forward of trained ensembles: trees, boosted trees and ridge regression, fitted anew at each decision row on the rows known by then."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import linear as L
from ..functions import series as S
from ..functions.series import clip, r6
from ..operators import trees as T
from ..sources.scratch import written
from .evaluation import COST, MIN_TRAIN, SIZE, STEPS
from .learning import FEATURES, MATRIX_SQL, matrix
from .refits import RIDGE, _centred_sql, _fitted_sql, _terms_sql
from .registry import query

WINDOW, STEP, BINS = 252, 20, 8  # rows of a training set, rows between decisions, bins of a feature
TREES, DEPTH, LEAST = 4, 3, 5  # of a forest: trees of either kind, levels, examples in a leaf
ROUNDS, RATE, SHALLOW = 4, 0.3, 2  # of boosting
UNIT = 10**6  # of targets and features as integers
MEMBERS = ("random_forest", "extra_trees", "boosted_trees", "ridge")

KEYS = ["series_id", "s"]


def learning_rows(rows: DataFrame, features: list[str]) -> DataFrame:
    """``series_id, d, i, y, v`` of a matrix: each row's place, its target and its features as integers."""
    rows = rows.withColumn("i", F.row_number().over(S.ordered()).cast("long"))
    whole = lambda c: F.round(F.col(c) * UNIT).cast("long")
    return rows.select("series_id", "d", "i", whole("target").alias("y"), F.array(*(whole(f) for f in features)).alias("v"))


def kept_of(n: int) -> int:
    """How many of ``n`` features are selected: a share of them, 24 at most, and one at least is left out."""
    wanted = min(24, max(6, round(0.65 * n)))
    return wanted if wanted < n else n - 1


def relevance(sets: DataFrame, n_features: int) -> DataFrame:
    """``*KEYS, feature, score, place`` in each training set of ``sets(*KEYS, i, w, y, v, x)``, by its training rows alone.

    Linear (F score) and binned mutual information with the sign of the target, each by the largest of the set, averaged; ties go to the earlier feature.
    """
    own = [*KEYS, "feature"]
    cells = sets.where("w > 0").select(*KEYS, "y", F.posexplode(F.arrays_zip("x", "v")).alias("feature", "c")).select(*own, "y", F.col("c.x").alias("bin"), F.col("c.v").alias("v"))
    v, y = F.col("v").cast("double") / UNIT, F.col("y").cast("double") / UNIT
    n = F.count("*")
    rho = F.try_divide(F.covar_samp(v, y), F.stddev_samp(v) * F.stddev_samp(y))
    linear = cells.groupBy(*own).agg(n.alias("n"), rho.alias("rho"))
    linear = linear.select(*own, F.coalesce(F.try_divide(F.col("rho") * F.col("rho"), 1 - F.col("rho") * F.col("rho")) * (F.col("n") - 2), F.lit(0.0)).alias("f_score"))
    up = (F.col("y") > 0).cast("int")
    table = cells.groupBy(*own, "bin", up.alias("up")).agg(n.alias("k"))
    total = lambda *more: F.sum("k").over(Window.partitionBy(*own, *more))
    table = table.withColumns({"kx": total("bin"), "ky": total("up"), "n": total()})
    c = {x: F.col(x).cast("double") for x in ("k", "n", "kx", "ky")}
    shared = table.groupBy(*own).agg(F.greatest(F.lit(0.0), F.sum(c["k"] / c["n"] * F.ln(c["k"] * c["n"] / (c["kx"] * c["ky"])))).alias("mi"))
    whole = Window.partitionBy(*KEYS)
    share = lambda x: F.coalesce(F.try_divide(F.col(x), F.max(x).over(whole)), F.lit(0.0))
    scored = linear.join(shared, own).withColumn("score", F.round((share("f_score") + share("mi")) / 2, 9))
    return scored.withColumn("place", F.row_number().over(whole.orderBy(F.desc("score"), "feature")))


def prepared(sets: DataFrame, n_features: int) -> DataFrame:
    """``sets(*KEYS, i, w, y, v)`` with bins and ``chosen``, the features selected in each set, the best first."""
    binned = written(T.with_bins(sets, KEYS, "v", BINS), "sets")
    best = relevance(binned, n_features).where(F.col("place") <= kept_of(n_features)).groupBy(*KEYS)
    best = best.agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "feature"))), lambda p: p["feature"]).alias("chosen"))
    return written(binned.join(best, KEYS), "sets")


def _member_trees(sets: DataFrame) -> DataFrame:
    """A bootstrap of each training set for each tree of the forest, the whole set for each tree with random cuts; weights from the places alone."""
    each = sets.withColumn("tree", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2 * TREES - 1).cast("long"))))
    i, t = F.col("i"), F.col("tree")
    u = (i * 7919 + t * 104729 + (i % 97) * t * 31337) % 1000
    drawn = F.when(u < 368, 0).when(u < 736, 1).when(u < 920, 2).when(u < 981, 3).otherwise(4)  # Poisson with mean 1
    sampled = (F.col("w") > 0) & (t < TREES)
    return each.where(~(sampled & (u < 368))).withColumn("w", F.when(sampled, drawn).otherwise(F.col("w")).cast("long"))


def _only_bin():
    cut = (F.col("s") * 7919 + F.col("tree") * 104729 + F.col("node") * 1299709 + F.col("feature").cast("long") * 15485863) % (BINS - 1)
    return F.when(F.col("tree") >= TREES, cut)


def tree_fits(sets: DataFrame) -> DataFrame:
    """``*KEYS, i`` of the rows of weight 0 of ``prepared`` sets, with the forecasts of the three kinds of trees."""
    by, sets = [*KEYS, "tree"], sets.select(*KEYS, "i", "y", "w", "x", "chosen")
    grown = T.with_leaf_means(written(T.grown(written(_member_trees(sets), "forest"), by, DEPTH, LEAST, _only_bin(), "chosen"), "forest"), by).where("w = 0")
    forest = grown.groupBy(*KEYS, "i").agg(*(F.avg(F.when(cond, F.col("mean"))).alias(m) for m, cond in ((MEMBERS[0], F.col("tree") < TREES), (MEMBERS[1], F.col("tree") >= TREES))))
    boosted = T.boosted(sets, KEYS, ROUNDS, RATE, SHALLOW, LEAST, "chosen").select(*KEYS, "i", F.col("fit").alias(MEMBERS[2]))
    return forest.join(boosted, [*KEYS, "i"]).select(*KEYS, "i", *((F.col(m) / UNIT).alias(m) for m in MEMBERS[:3]))


def ensemble_fits(spark, sf_dir) -> DataFrame:
    """Decision rows with the members' forecasts and the ensemble's, weighted by each member's skill in earlier decision rows, all of them matured."""
    table = matrix(spark, sf_dir)
    sets = prepared(T.training_sets(learning_rows(table, FEATURES).drop("d"), MIN_TRAIN, STEP, STEPS, WINDOW), len(FEATURES))
    chosen = F.array_join(F.sort_array("chosen"), ",").alias("chosen")
    trees = tree_fits(sets).join(sets.where("w = 0").select(*KEYS, "i", chosen), [*KEYS, "i"]).drop("s")
    rows = table.withColumn("i", F.row_number().over(S.ordered()).cast("long")).withColumns({f"{f}_c": L.centred(f) for f in FEATURES})
    x, y = [F.lit(1.0), *(F.col(f"{f}_c") for f in FEATURES)], F.col("target")
    fits = rows.withColumns(L.known_sums(rows, L.normal_terms(x, y), STEPS, WINDOW)).where((F.col("i") > MIN_TRAIN) & ((F.col("i") - 1) % STEP == 0))
    fits = L.solved(fits, len(x), RIDGE).withColumn("ridge", L.applied(x)).join(trees, ["series_id", "i"])
    seen = S.ordered().rowsBetween(Window.unboundedPreceding, -(-(-STEPS // STEP)))
    spread = F.var_pop("target").over(seen)
    for m in MEMBERS:
        p = F.col(m)
        fit = 1 - F.avg((y - p) * (y - p)).over(seen) / F.when(spread > 0, spread)
        weight = clip(0.4 * clip(F.coalesce(fit, F.lit(0.0)), 0.0, 1.0) + 0.6 * F.avg((S.sign(p) == S.sign(y)).cast("double")).over(seen), 0.3, 1.0)
        fits = fits.withColumn(f"{m}_w", F.coalesce(F.when(F.count("*").over(seen) > 0, weight), F.lit(0.5)))
    total = sum((F.col(f"{m}_w") for m in MEMBERS[1:]), F.col(f"{MEMBERS[0]}_w"))
    mean = sum((F.col(m) * F.col(f"{m}_w") for m in MEMBERS[1:]), F.col(MEMBERS[0]) * F.col(f"{MEMBERS[0]}_w")) / total
    return fits.withColumns({"ensemble": mean, "n_train": F.col("n").cast("long")})


def _grow_sql(name: str, source: str, depth: int, key: str, only: str | None, n_features: int) -> str:
    """The levels of the trees of ``source``; the last is ``name``."""
    steps, rows = [], f"(SELECT *, CAST(1 AS BIGINT) AS node FROM {source})"
    for level in range(depth):
        c, k, b, out = (f"{name}_{x}{level}" for x in "ckbr")
        tried = "true" if only is None else f"({only} IS NULL OR (bin <= {only} AND (nxt IS NULL OR nxt > {only})))"
        own = f"{key}, node, feature"
        steps += [
            f"{c} AS (SELECT {own}, bin, sum(w) AS n, sum(w * y) AS t FROM (SELECT {key}, node, w, y, chosen, unnest(range({n_features})) AS feature, unnest(x) AS bin FROM {rows} WHERE w > 0) WHERE list_contains(chosen, feature) GROUP BY {own}, bin)",
            f"{k} AS (SELECT *, sum(n) OVER o AS nl, sum(t) OVER o AS tl, sum(n) OVER q AS an, sum(t) OVER q AS total, lead(bin) OVER q2 AS nxt FROM {c} WINDOW o AS (PARTITION BY {own} ORDER BY bin ROWS UNBOUNDED PRECEDING), q AS (PARTITION BY {own}), q2 AS (PARTITION BY {own} ORDER BY bin))",
            f"{b} AS (SELECT {key}, node, arg_max(row(feature, bin), row(CAST(tl AS DOUBLE) * CAST(tl AS DOUBLE) / CAST(nl AS DOUBLE) + CAST(total - tl AS DOUBLE) * CAST(total - tl AS DOUBLE) / CAST(an - nl AS DOUBLE), -feature, -bin)) AS split FROM {k} WHERE nl >= {LEAST} AND an - nl >= {LEAST} AND {tried} GROUP BY {key}, node)",
            f"{out} AS MATERIALIZED (SELECT r.* REPLACE (CASE WHEN split IS NULL THEN r.node ELSE 2 * r.node + CAST(r.x[split[1] + 1] > split[2] AS BIGINT) END AS node) FROM {rows} r LEFT JOIN {b} USING ({key}, node))",
        ]
        rows = out
    steps.append(f"{name} AS (SELECT r.*, m.mean FROM {rows} r JOIN (SELECT {key}, node, CAST(sum(w * y) AS DOUBLE) / CAST(sum(w) AS DOUBLE) AS mean FROM {rows} WHERE w > 0 GROUP BY {key}, node) m USING ({key}, node))")
    return ", ".join(steps)


def _walk_sets_sql(features) -> list[str]:
    ints = ", ".join(f"CAST(round({f} * {UNIT}) AS BIGINT)" for f in features)
    return [
        f"lr0 AS MATERIALIZED (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY d) AS i, CAST(round(target * {UNIT}) AS BIGINT) AS y, [{ints}] AS v FROM mx)",
        f"ts AS (SELECT series_id, i, y, v, s, 1 AS w FROM (SELECT *, unnest(generate_series(CAST(ceil((greatest(i + {STEPS}, {MIN_TRAIN + 1}) - 1) / {STEP}) AS BIGINT) * {STEP} + 1, least(last, i + {STEPS + WINDOW - 1}), {STEP})) AS s FROM (SELECT *, max(i) OVER (PARTITION BY series_id) AS last FROM lr0)) "
        f"UNION ALL SELECT series_id, i, y, v, i, 0 FROM lr0 WHERE i > {MIN_TRAIN} AND (i - 1) % {STEP} = 0)",
    ]


def _prepared_sql(n_features: int) -> list[str]:
    """From the training sets ``ts`` to ``st``, with bins and selected features."""
    key = "series_id, s"
    return [
        f"cl AS MATERIALIZED (SELECT {key}, i, w, y, unnest(range({n_features})) AS feature, unnest(v) AS v FROM ts)",
        f"rk AS (SELECT *, row_number() OVER (PARTITION BY {key}, feature ORDER BY v, i) AS rank, count(*) OVER (PARTITION BY {key}, feature) AS n FROM cl WHERE w > 0)",
        f"bd AS (SELECT {key}, feature, [{', '.join(f'max(v) FILTER (WHERE rank = {k} * n // {BINS})' for k in range(1, BINS))}] AS bounds FROM rk GROUP BY ALL)",
        f"bn AS MATERIALIZED (SELECT cl.*, len(list_filter(bounds, lambda e: cl.v > e)) AS bin FROM cl JOIN bd USING ({key}, feature))",
        f"fs AS (SELECT {key}, feature, count(*) AS n, covar_samp(v / {UNIT}, y / {UNIT}) / nullif(stddev_samp(v / {UNIT}) * stddev_samp(y / {UNIT}), 0) AS rho FROM bn WHERE w > 0 GROUP BY ALL)",
        f"mi0 AS (SELECT {key}, feature, bin, y > 0 AS up, count(*) AS k FROM bn WHERE w > 0 GROUP BY ALL)",
        f"mi1 AS (SELECT *, sum(k) OVER (PARTITION BY {key}, feature, bin) AS kx, sum(k) OVER (PARTITION BY {key}, feature, up) AS ky, sum(k) OVER (PARTITION BY {key}, feature) AS n FROM mi0)",
        f"mi AS (SELECT {key}, feature, greatest(0, sum(k / n * ln(k * n / (kx * ky)))) AS mi FROM mi1 GROUP BY ALL)",
        f"sc0 AS (SELECT {key}, feature, coalesce(rho * rho / nullif(1 - rho * rho, 0) * (n - 2), 0) AS f_score, mi FROM fs JOIN mi USING ({key}, feature))",
        f"sc AS (SELECT *, round((coalesce(f_score / nullif(max(f_score) OVER q, 0), 0) + coalesce(mi / nullif(max(mi) OVER q, 0), 0)) / 2, 9) AS score FROM sc0 WINDOW q AS (PARTITION BY {key}))",
        f"pl AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, feature) AS place FROM sc)",
        f"ch AS (SELECT {key}, list(feature ORDER BY place) AS chosen FROM pl WHERE place <= {kept_of(n_features)} GROUP BY ALL)",
        f"st AS MATERIALIZED (SELECT b.*, chosen FROM (SELECT {key}, i, any_value(w) AS w, any_value(y) AS y, list(v ORDER BY feature) AS v, list(bin ORDER BY feature) AS x FROM bn GROUP BY {key}, i) b JOIN ch USING ({key}))",
    ]


def _tree_fits_sql(n_features: int) -> list[str]:
    """From ``st`` to ``tf``, the forecasts of the rows of weight 0."""
    key = "series_id, s"
    u = "(i * 7919 + tree * 104729 + (i % 97) * tree * 31337) % 1000"
    only = f"(CASE WHEN tree >= {TREES} THEN (s * 7919 + tree * 104729 + node * 1299709 + feature * 15485863) % {BINS - 1} END)"
    parts = [
        f"fo AS MATERIALIZED (SELECT * REPLACE (CASE WHEN w > 0 AND tree < {TREES} THEN CASE WHEN {u} < 736 THEN 1 WHEN {u} < 920 THEN 2 WHEN {u} < 981 THEN 3 ELSE 4 END ELSE w END AS w) FROM st, range({2 * TREES}) t(tree) WHERE NOT (w > 0 AND tree < {TREES} AND {u} < 368))",
        _grow_sql("fg", "fo", DEPTH, "series_id, s, tree", only, n_features),
        f"ff AS (SELECT {key}, i, avg(mean) FILTER (WHERE tree < {TREES}) / {UNIT} AS random_forest, avg(mean) FILTER (WHERE tree >= {TREES}) / {UNIT} AS extra_trees, array_to_string(list_sort(any_value(chosen)), ',') AS chosen FROM fg WHERE w = 0 GROUP BY ALL)",
    ]
    source = "(SELECT * REPLACE (CASE WHEN w > 0 THEN y ELSE 0 END AS y) FROM st)"
    for k in range(ROUNDS + 1):
        parts.append(_grow_sql(f"bg{k}", source, SHALLOW if k else 0, key, None, n_features))
        parts.append(f"bo{k} AS MATERIALIZED (SELECT {key}, i, w, x, chosen, y - CAST(round({RATE if k else 1.0} * mean) AS BIGINT) AS y FROM bg{k})")
        source = f"bo{k}"
    parts.append(f"tf AS (SELECT ff.*, -bo{ROUNDS}.y / {UNIT} AS boosted_trees FROM ff JOIN bo{ROUNDS} USING ({key}, i) WHERE bo{ROUNDS}.w = 0)")
    return parts


def _trees_sql() -> str:
    return ", ".join([*_walk_sets_sql(FEATURES), *_prepared_sql(len(FEATURES)), *_tree_fits_sql(len(FEATURES))])


_X = ["1.0", *(f"{f}_c" for f in FEATURES)]
_SUMS = ", ".join(f"coalesce(sum({t}) OVER p, 0) AS {name}" for name, t in _terms_sql(_X, "target").items())


def _weight_sql(m):
    return f"CASE WHEN count(*) OVER k > 0 THEN least(1, greatest(0.3, 0.4 * greatest(0, least(1, coalesce(1 - avg((target - {m}) ** 2) OVER k / nullif(var_pop(target) OVER k, 0), 0))) + 0.6 * avg(CASE WHEN sign({m}) = sign(target) THEN 1.0 ELSE 0.0 END) OVER k)) ELSE 0.5 END AS {m}_w"


ENSEMBLE_SQL = f"""{MATRIX_SQL}, {_trees_sql()},
rm AS (SELECT series_id, d, close, target, row_number() OVER (PARTITION BY series_id ORDER BY d) AS i, {_centred_sql(FEATURES)} FROM mx),
rs AS (SELECT * FROM (SELECT *, {_SUMS} FROM rm WINDOW p AS (PARTITION BY series_id ORDER BY d ROWS BETWEEN {WINDOW + STEPS - 1} PRECEDING AND {STEPS} PRECEDING)) WHERE i > {MIN_TRAIN} AND (i - 1) % {STEP} = 0), {L.elimination_sql('rs', 'sol', len(_X), RIDGE)},
en0 AS (SELECT sol.series_id, sol.d, sol.i, close, target, n, chosen, {', '.join(MEMBERS[:3])}, {_fitted_sql(_X)} AS ridge FROM sol JOIN tf USING (series_id, i)),
en1 AS (SELECT *, {', '.join(_weight_sql(m) for m in MEMBERS)} FROM en0 WINDOW k AS (PARTITION BY series_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND {-(-STEPS // STEP)} PRECEDING)),
en AS (SELECT *, ({' + '.join(f'{m} * {m}_w' for m in MEMBERS)}) / ({' + '.join(f'{m}_w' for m in MEMBERS)}) AS ensemble FROM en1)"""


@query(
    "walkforward_trees",
    f"""WITH {ENSEMBLE_SQL} SELECT series_id, d, CAST(n AS BIGINT) AS n_train, chosen, {', '.join(f'round({m}, 6) AS {m}' for m in (*MEMBERS, 'ensemble'))}, round(target, 6) AS actual FROM en""",
)
def walkforward_trees(spark, sf_dir):
    """Five-bar returns forecast by a random forest, trees with random cuts, boosted trees and ridge regression, trained at each decision row, and by their ensemble.

    A training set is the last 252 rows whose targets are known by then; features are selected in it alone.
    """
    return ensemble_fits(spark, sf_dir).select("series_id", "d", "n_train", "chosen", *(r6(F.col(m)).alias(m) for m in (*MEMBERS, "ensemble")), r6(F.col("target")).alias("actual"))


@query(
    "walkforward_trees_metrics",
    f"""WITH {ENSEMBLE_SQL}, f AS (SELECT series_id, CAST(year(d) AS INTEGER) AS year, close, target, unnest([{', '.join(repr(m) for m in (*MEMBERS, 'ensemble'))}]) AS model, unnest([{', '.join((*MEMBERS, 'ensemble'))}]) AS p FROM en),
    t AS (SELECT *, CASE WHEN sign(p) <> 0 THEN round(sign(p) * target * close * {SIZE} - {COST}, 2) END AS pnl FROM f)
    SELECT series_id, year, model, count(*) AS n, round(avg(abs(target - p)), 6) AS mae, round(sqrt(avg((target - p) ** 2)), 6) AS rmse, round(CASE WHEN var_pop(target) > 0 THEN 1 - avg((target - p) ** 2) / var_pop(target) ELSE 0 END, 6) AS r2,
    round(100 * avg(CASE WHEN sign(p) = sign(target) THEN 1.0 ELSE 0.0 END), 4) AS direction_accuracy, count(pnl) AS n_trades, round(sum(pnl), 2) AS total_pnl FROM t GROUP BY ALL""",
)
def walkforward_trees_metrics(spark, sf_dir):
    """Errors, directions and trades of every member and of the ensemble by series and year."""
    y, p = F.col("target"), F.col("p")
    rows = ensemble_fits(spark, sf_dir).select("series_id", F.year("d").alias("year"), "close", "target", *MEMBERS, "ensemble").unpivot(["series_id", "year", "close", "target"], [*MEMBERS, "ensemble"], "model", "p")
    pnl, var = F.when(S.sign(p) != 0, F.round(S.sign(p) * y * F.col("close") * SIZE - COST, 2)), F.var_pop(y)
    error = F.avg((y - p) * (y - p))
    return rows.groupBy("series_id", "year", "model").agg(
        F.count("*").alias("n"), r6(F.avg(F.abs(y - p))).alias("mae"), r6(F.sqrt(error)).alias("rmse"), r6(F.when(var > 0, 1 - error / F.when(var > 0, var)).otherwise(0.0)).alias("r2"),
        F.round(100 * F.avg((S.sign(p) == S.sign(y)).cast("double")), 4).alias("direction_accuracy"), F.count(pnl).alias("n_trades"), F.round(F.sum(pnl), 2).alias("total_pnl"),
    )
