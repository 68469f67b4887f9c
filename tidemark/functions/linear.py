"""Small linear systems solved in columns, and sums over the rows whose targets are known."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import series as S

TINY = 1e-12


def pairs(k: int) -> list[tuple[int, int]]:
    return list(combinations_with_replacement(range(k), 2))


def known_sums(rows: DataFrame, terms: dict[str, Column], lag: int, window: int | None) -> dict[str, Column]:
    """A running sum of each term over the rows ``lag`` or more before each row, or over the last ``window`` of those.

    A sliding sum is the difference of two running ones, so no row is added up more than twice.
    """

    def running(term: Column, behind: int) -> Column:
        return F.coalesce(F.sum(term).over(S.ordered().rowsBetween(Window.unboundedPreceding, -behind)), F.lit(0.0))

    return {name: running(t, lag) if window is None else running(t, lag) - running(t, lag + window) for name, t in terms.items()}


def normal_terms(x: list[Column], y: Column, usable: Column | None = None) -> dict[str, Column]:
    """The terms of the normal equations of ``y`` on ``x``: ``a_i_j``, ``b_i`` and the number of rows ``n``."""
    own = (lambda c: F.when(usable, c)) if usable is not None else (lambda c: c)
    terms = {f"a_{i}_{j}": own(x[i] * x[j]) for i, j in pairs(len(x))} | {f"b_{i}": own(v * y) for i, v in enumerate(x)}
    return terms | {"n": own(F.lit(1.0))}


def centred(c: str) -> Column:
    """``c`` less the series' first value, so that sums of products lose less to rounding."""
    return F.col(c) - F.first(c, ignorenulls=True).over(S.past())


def solved(rows: DataFrame, k: int, ridge: float = 0.0) -> DataFrame:
    """Columns ``beta_i`` that solve the equations ``a_i_j``, ``b_i`` by square-root-free Cholesky; null where they have no single solution.

    ``ridge`` times ``n`` is added to the diagonal but for the first regressor, the constant. A projection for each regressor down and one up;
    the right side is reduced along with the matrix, as one more of its rows.
    """
    a = lambda i, j: F.col(f"a_{min(i, j)}_{max(i, j)}")
    low = lambda i, m: F.col(f"l_{i}_{m}")
    less = lambda v, own, j: v - sum((own(m) * low(j, m) * F.col(f"d_{m}") for m in range(j)), F.lit(0.0))
    for j in range(k):
        own = a(j, j) + (ridge * F.col("n") if j and ridge else F.lit(0.0))
        rest = less(own, lambda m: low(j, m), j)  # noqa: B023
        pivot = F.when((F.col("n") >= k) & (rest > TINY * F.abs(own)), rest)
        below = {f"l_{i}_{j}": less(a(i, j), lambda m: low(i, m), j) / pivot for i in range(j + 1, k)}  # noqa: B023
        rows = rows.withColumns({f"d_{j}": pivot, f"z_{j}": less(F.col(f"b_{j}"), lambda m: F.col(f"z_{m}"), j) / pivot} | below)
    for i in reversed(range(k)):
        rows = rows.withColumn(f"beta_{i}", F.col(f"z_{i}") - sum((low(m, i) * F.col(f"beta_{m}") for m in range(i + 1, k)), F.lit(0.0)))
    spare = [c for c in rows.columns if c.split("_")[0] in ("l", "d", "z", "a", "b") and c.split("_")[-1].isdigit()]
    return rows.drop(*spare)


def applied(x: list[Column]) -> Column:
    """The fitted value at ``x`` by the columns ``beta_i``."""
    return sum((F.col(f"beta_{i}") * v for i, v in enumerate(x[1:], 1)), F.col("beta_0") * x[0])


def elimination_sql(source: str, name: str, k: int, ridge: float = 0.0) -> str:
    """Common table expressions that solve the same equations in ``source`` by Gauss-Jordan elimination; the last is ``name``, with ``beta_i``.

    For oracles: another method than ``solved``.
    """
    own = [f"a_{min(i, j)}_{max(i, j)} AS g_{i}_{j}" if not (ridge and i == j and i) else f"a_{i}_{i} + {ridge!r} * n AS g_{i}_{i}" for i in range(k) for j in range(k)]
    steps = [f"{name}_0 AS (SELECT *, {', '.join(own)}, {', '.join(f'b_{i} AS g_{i}_{k}' for i in range(k))} FROM {source})"]
    for p in range(k):
        cells = [f"g_{i}_{j} - g_{i}_{p} / g_{p}_{p} * g_{p}_{j} AS g_{i}_{j}" for i in range(k) if i != p for j in range(p + 1, k + 1)]
        steps.append(f"{name}_{p + 1} AS (SELECT * REPLACE ({', '.join(cells)}) FROM {name}_{p})")
    steps.append(f"{name} AS (SELECT *, {', '.join(f'CASE WHEN n >= {k} THEN g_{i}_{k} / g_{i}_{i} END AS beta_{i}' for i in range(k))} FROM {name}_{k})")
    return ", ".join(steps)
