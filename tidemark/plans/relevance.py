"""Relevance of features by nearest-neighbour mutual information and F scores."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import series as S
from ..functions.series import clip, r6
from ..operators import neighbours as N
from .learning import FEATURES, MATRIX_SQL, matrix
from .registry import query

NEIGHBOURS = 3


def _psi_sql(n):
    z = f"({n} + 6.0::DOUBLE)"
    return f"(ln({z}) - 1 / (2 * {z}) - 1 / (12 * {z} * {z}) + 1 / (120 * {z} ** 4) - 1 / (252 * {z} ** 6) - ({' + '.join(f'1 / ({n} + {j}.0::DOUBLE)' for j in range(6))}))"


@query(
    "feature_relevance_neighbours",
    f"""WITH {MATRIX_SQL}, lng AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY d) AS id, unnest([{', '.join(repr(f) for f in FEATURES)}]) AS feature, unnest([{', '.join(FEATURES)}]) AS v, target FROM mx),
    pt AS MATERIALIZED (SELECT series_id, feature, id, coalesce(CAST(round(v / nullif(stddev_pop(v) OVER g, 0) * {N.UNIT}) AS BIGINT), 0) AS x, coalesce(CAST(round(target / nullif(stddev_pop(target) OVER g, 0) * {N.UNIT}) AS BIGINT), 0) AS y FROM lng WINDOW g AS (PARTITION BY series_id, feature)),
    rd AS MATERIALIZED (SELECT a.series_id, a.feature, a.id, any_value(a.x) AS x, any_value(a.y) AS y, min(greatest(abs(a.x - b.x), abs(a.y - b.y)), {NEIGHBOURS})[{NEIGHBOURS}] AS r FROM pt a JOIN pt b ON a.series_id = b.series_id AND a.feature = b.feature AND a.id <> b.id GROUP BY 1, 2, 3),
    nn AS (SELECT a.series_id, a.feature, a.id, greatest(1, count(*) FILTER (WHERE abs(a.x - b.x) < r)) AS nx, greatest(1, count(*) FILTER (WHERE abs(a.y - b.y) < r)) AS ny FROM rd a JOIN pt b ON a.series_id = b.series_id AND a.feature = b.feature GROUP BY 1, 2, 3),
    i AS (SELECT series_id, feature, greatest(0, {_psi_sql('count(*)')} + {_psi_sql(str(NEIGHBOURS))} - avg({_psi_sql('nx')}) - avg({_psi_sql('ny')})) AS mi FROM nn GROUP BY 1, 2),
    rr AS (SELECT series_id, feature, count(*) AS n, covar_samp(v, target) / nullif(stddev_samp(v) * stddev_samp(target), 0) AS rho FROM lng GROUP BY 1, 2),
    f AS (SELECT series_id, feature, coalesce(rho * rho / nullif(1 - rho * rho, 0) * (n - 2), 0) AS f_score FROM rr), j AS (SELECT *, (coalesce(f_score / nullif(max(f_score) OVER s, 0), 0) + coalesce(mi / nullif(max(mi) OVER s, 0), 0)) / 2 AS score, count(*) OVER s AS total FROM f JOIN i USING (series_id, feature) WINDOW s AS (PARTITION BY series_id)),
    k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(score, 9) DESC, feature) AS place, CASE WHEN least(24, greatest(6, round(0.65 * total))) < total THEN least(24, greatest(6, round(0.65 * total))) ELSE total - 1 END AS kept FROM j)
    SELECT series_id, feature, round(f_score, 4) AS f_score, round(mi, 6) AS mutual_information, round(score, 6) AS score, CAST(place AS INTEGER) AS place, place <= kept AS selected FROM k""",
)
def feature_relevance_neighbours(spark, sf_dir):
    """F scores and mutual information by the third nearest neighbour, each by its largest, averaged; the best are selected, one at least is left out."""
    own = ["series_id", "feature"]
    rows = matrix(spark, sf_dir).withColumn("id", F.row_number().over(S.ordered()).cast("long")).unpivot(["series_id", "id", "target"], list(FEATURES), "feature", "v")
    shared = N.mutual_information(rows.select(*own, "id", N.scaled("v", own).alias("x"), N.scaled("target", own).alias("y")), own, NEIGHBOURS)
    rho = F.try_divide(F.covar_samp("v", "target"), F.stddev_samp("v") * F.stddev_samp("target"))
    f = rows.groupBy(*own).agg(F.count("*").alias("n"), rho.alias("rho"))
    f = f.select(*own, F.coalesce(F.try_divide(F.col("rho") * F.col("rho"), 1 - F.col("rho") * F.col("rho")) * (F.col("n") - 2), F.lit(0.0)).alias("f_score"))
    whole = Window.partitionBy("series_id")
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.max(c).over(whole)), F.lit(0.0))
    j = f.join(shared, own).withColumns({"score": (share("f_score") + share("mi")) / 2, "total": F.count("*").over(whole)})
    wanted = clip(F.round(0.65 * F.col("total")), 6.0, 24.0)
    kept = F.when(wanted < F.col("total"), wanted).otherwise(F.col("total") - 1)
    place = F.row_number().over(Window.partitionBy("series_id").orderBy(F.round("score", 9).desc(), "feature"))
    return j.select(*own, F.round("f_score", 4).alias("f_score"), r6(F.col("mi")).alias("mutual_information"), r6(F.col("score")).alias("score"), place.alias("place"), (place <= kept).alias("selected"))
