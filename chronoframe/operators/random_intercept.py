"""Random-intercept models fitted on the executors (K3 for one grouping factor of any size).

``y = X b + u[group] + e`` by maximum likelihood.  With the ratio ``t = var(u) / var(e)``
fixed, b and var(e) have closed forms in sums per group level, so the whole fit is a
search over t:

1. one aggregation gives each level's count and sums, another their totals;
2. a round evaluates ``POINTS`` ratios at once: every level adds its terms for each
   (partial sums on the executors), and one row a ratio reaches the driver, whose size
   depends on the number of fixed terms alone;
3. the next round looks between the neighbours of the best ratio, ``ROUNDS`` in all.

Ratios are searched as ``s = t / (1 + t)`` in [0, 1), first evenly, so the round's best
cell is found also where the likelihood has several maxima further apart than a cell.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.operators.mixed import chi2_sf
from chronoframe.sources.tables import stage_table

POINTS = 17  # ratios of a round
ROUNDS = 10  # each narrows the range by (POINTS - 1) / 2
TOP = 0.999999  # largest s


@dataclass(frozen=True)
class InterceptFit:
    fixed: tuple[str, ...]
    ratio: float  # var(u) / var(e)
    variance: float  # var(e)
    beta: tuple[float, ...]  # intercept first
    loglik: float
    n: int
    levels: int

    @property
    def npar(self) -> int:
        return len(self.beta) + 2


def _pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def level_sums(df: DataFrame, response: str, fixed: Sequence[str], group: str) -> tuple[DataFrame, DataFrame]:
    """(sums per level, their totals in one row); rows with a missing value take no part.

    Column s_i sums term i (0: the intercept, last: the response), q_i_j products of terms.
    """
    names = [*fixed, response]
    known = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in names]
    rows = df.where(F.col(group).isNotNull())
    for k in known:
        rows = rows.where(k)
    terms = [F.lit(1.0), *(F.col(c).cast("double") for c in names)]
    products = [F.sum(terms[i] * terms[j]).alias(f"q_{i}_{j}") for i, j in _pairs(len(terms))]
    levels = stage_table(rows.groupBy(F.col(group).alias("level")).agg(*products), "level-sums")
    totals = levels.agg(F.count(F.lit(1)).alias("levels"), *(F.sum(f"q_{i}_{j}").alias(f"q_{i}_{j}") for i, j in _pairs(len(terms))))
    return levels, totals


def _evaluate(levels: DataFrame, totals: dict, k: int, use: Sequence[int], ratios: Sequence[float]) -> list[tuple]:
    """(loglik, ratio, beta, variance) for each ratio; ``use``: the fixed terms of the model."""
    own = [*use, k - 1]
    t = F.col("t")
    n = F.col("q_0_0")
    w = t / (1 + t * n)
    added = [
        F.sum(w * F.col(f"q_0_{own[i]}") * F.col(f"q_0_{own[j]}")).alias(f"a_{i}_{j}") for i, j in _pairs(len(own))
    ]
    spread = levels.withColumn("t", F.explode(F.array(*map(F.lit, ratios))))
    rows = spread.groupBy("t").agg(F.sum(F.log1p(t * n)).alias("logdet"), *added).collect()  # one a ratio
    out = []
    for r in rows:
        m = np.zeros((len(own), len(own)))
        for i, j in _pairs(len(own)):
            a, b = sorted((own[i], own[j]))
            m[i, j] = m[j, i] = totals[f"q_{a}_{b}"] - r[f"a_{i}_{j}"]
        beta = np.linalg.lstsq(m[:-1, :-1], m[:-1, -1], rcond=None)[0]
        rss = max(m[-1, -1] - m[:-1, -1] @ beta, 1e-300)
        size = totals["q_0_0"]
        loglik = -0.5 * (size * (math.log(2 * math.pi * rss / size) + 1) + r["logdet"])
        out.append((loglik, -r["t"], tuple(beta), rss / size))
    return out


def fit_random_intercept(
    levels: DataFrame, totals: DataFrame, names: Sequence[str], fixed: Sequence[str]
) -> InterceptFit:
    """Fit with the ``fixed`` terms among ``names``, from the sums of ``level_sums``."""
    sums = totals.first().asDict()
    if not sums["levels"]:
        raise ValueError("no row has all values")
    use = [0, *(1 + list(names).index(c) for c in fixed)]
    low, high, best = 0.0, TOP, None
    for _ in range(ROUNDS):
        points = [low + (high - low) * i / (POINTS - 1) for i in range(POINTS)]
        found = _evaluate(levels, sums, len(names) + 2, use, [s / (1 - s) for s in points])
        best = max([*found, best] if best else found)  # ties: the smaller ratio
        s = -best[1] / (1 - best[1])
        step = (high - low) / (POINTS - 1)
        low, high = max(0.0, s - step), min(TOP, s + step)
    loglik, ratio, beta, variance = best
    return InterceptFit(tuple(fixed), -ratio, variance, beta, loglik, int(sums["q_0_0"]), sums["levels"])


def random_intercept_test(
    df: DataFrame, response: str, fixed: Sequence[str], group: str, null: Sequence[str] = ()
) -> DataFrame:
    """Two rows: the model with the ``null`` terms and the one with ``fixed`` added, and their likelihood-ratio test.

    Columns: model, npar, n, levels, ML (log-likelihood), AIC, ratio, Chisq,
    Df, p_value (NULL in the null model's row).  Rows with a missing response,
    term or group take no part, in either model.
    """
    names = list(dict.fromkeys([*null, *fixed]))
    levels, totals = level_sums(df, response, names, group)
    small = fit_random_intercept(levels, totals, names, list(dict.fromkeys(null)))
    large = fit_random_intercept(levels, totals, names, names)
    rows = []
    for fit in (small, large):
        model = " + ".join(["1", *fit.fixed, f"(1 | {group})"])
        test = (None, None, None)
        if fit is large:
            chisq, more = max(2 * (large.loglik - small.loglik), 0.0), large.npar - small.npar
            test = (chisq, more, chi2_sf(chisq, more))
        rows.append((f"{response} ~ {model}", fit.npar, fit.n, fit.levels, fit.loglik, 2 * fit.npar - 2 * fit.loglik, fit.ratio, *test))
    schema = "model string, npar int, n long, levels long, ML double, AIC double, ratio double, Chisq double, Df int, p_value double"
    return df.sparkSession.createDataFrame(rows, schema)
