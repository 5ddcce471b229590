"""Fitted curves for plots (K1 linear, K2 smoothing spline).

The heavy part (sums over all rows) is a Spark aggregation.  Nothing reaches
the driver; K2 solves one small system per curve in a task, from eleven sums
per knot interval.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.operators.frames import _blocked_range
from chronoframe.sources.tables import stage_table

# the per-curve solve travels with its task, so workers need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def linear_curve(
    df: DataFrame,
    response: str,
    term: str,
    keys: Sequence[str] = (),
    step_per_unit: int = 100,
) -> DataFrame:
    """K1: least-squares line of ``response ~ term`` on a grid of the term.

    Grid: x = (min*100 + k)/100 for k = 0 .. floor(max*100 - min*100), i.e.
    steps of 0.01 from the smallest to the largest term value.  The fit uses
    complete (x, y) pairs; a constant term predicts the mean response.
    """
    s = float(step_per_unit)
    x, y = F.col(term).cast("double"), F.col(response).cast("double")
    complete = x.isNotNull() & y.isNotNull()
    fit = df.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("_slope"),
        F.regr_intercept(y, x).alias("_icept"),
        F.avg(F.when(complete, y)).alias("_ybar"),
        (F.min(x) * s).alias("_lo"),
        (F.max(x) * s).alias("_hi"),
    )
    fit = fit.where(F.col("_lo").isNotNull()).withColumn(
        "_cnt", (F.floor(F.col("_hi") - F.col("_lo") + F.lit(1e-9)) + 1).cast("int")
    )
    # the grid grows with the term's range, not with rows: expand it in blocks
    grid = _blocked_range(fit, "_cnt", "_k", [c for c in fit.columns if c != "_cnt"])
    gx = (F.col("_lo") + F.col("_k")) / F.lit(s)
    slope = F.coalesce(F.col("_slope"), F.lit(0.0))
    icept = F.coalesce(F.col("_icept"), F.col("_ybar"))
    return grid.select(*keys, gx.alias("x"), (icept + slope * gx).alias("y"))


# ---- K2: cubic smoothing spline --------------------------------------------
def n_knots(n_unique: int) -> int:
    """Knots for so many unique x: all below 50, then slowly growing, never cut off.

    Between 50, 200, 800 and 3200 points the count rises geometrically through
    50, 100, 140 and 200; beyond, by the fifth root of the points over 3200.
    """
    if n_unique < 50:
        return n_unique
    stops, counts = (50, 200, 800, 3200), (50, 100, 140, 200)
    for k in range(3):
        if n_unique < stops[k + 1]:
            share = (n_unique - stops[k]) / (stops[k + 1] - stops[k])
            return math.trunc(counts[k] * (counts[k + 1] / counts[k]) ** share)
    return math.trunc(200 + (n_unique - 3200) ** 0.2)


def spline_pieces(knots: np.ndarray) -> np.ndarray:
    """(interval, basis 0..3, power 0..3): the cubic B-splines alive on each interval, in u = (x - lo) / h."""
    m = len(knots) - 1
    t = np.concatenate([[knots[0]] * 3, knots, [knots[-1]] * 3])
    at = np.array([0.0, 1 / 3, 2 / 3, 1.0])
    to_powers = np.linalg.inv(np.vander(at, 4, increasing=True))
    out = np.empty((m, 4, 4))
    for i in range(m):
        x = knots[i] + at * (knots[i + 1] - knots[i])
        values = [np.ones(4)]
        for degree in range(1, 4):  # the recursion over degrees, for the span [t[i+3], t[i+4])
            grown = [np.zeros(4) for _ in range(degree + 1)]
            for r in range(degree):
                left, right = t[i + 4 + r - degree], t[i + 4 + r]
                part = values[r] / (right - left)
                grown[r] += part * (right - x)
                grown[r + 1] += part * (x - left)
            values = grown
        out[i] = np.array(values) @ to_powers.T
    return out


def solve_spline(knots: np.ndarray, moments: np.ndarray, y_moments: np.ndarray, spar: float) -> np.ndarray:
    """Per interval the fitted cubic's coefficients in u.

    ``moments[i, p]``: sum of w u^p (p to 6); ``y_moments[i, p]``: sum of w y u^p (p to 3).
    Penalty: lambda times the integrated squared second derivative, with
    lambda = ratio * 256^(3 spar - 1) and ratio = tr(X'WX) / tr(penalty) over
    the basis functions that are not cut off at either end.

    The penalty does not see straight lines.  They have coordinates of their own, so
    that no rounding of a large penalty reaches them: strong smoothing ends at the
    least-squares line.
    """
    pieces = spline_pieces(knots)
    m = len(pieces)
    gram, rough, rhs = np.zeros((m + 3, m + 3)), np.zeros((m + 3, m + 3)), np.zeros(m + 3)
    powers = np.add.outer(np.arange(4), np.arange(4))
    for i in range(m):
        b, h = pieces[i], knots[i + 1] - knots[i]
        gram[i : i + 4, i : i + 4] += b @ moments[i][powers] @ b.T
        rhs[i : i + 4] += b @ y_moments[i]
        bend = np.stack([2 * b[:, 2], 6 * b[:, 3]], axis=1)  # second derivative times h^2: constant and slope in u
        rough[i : i + 4, i : i + 4] += bend @ np.array([[1, 1 / 2], [1 / 2, 1 / 3]]) @ bend.T / h**3
    inner = slice(2, m) if m > 2 else slice(0, m + 3)
    ratio = np.trace(gram[inner, inner]) / np.trace(rough[inner, inner])
    padded = np.concatenate([[knots[0]] * 3, knots, [knots[-1]] * 3])
    abscissae = (padded[1:-3] + padded[2:-2] + padded[3:-1]) / 3  # coefficients of the line y = x
    lines = np.stack([np.ones(m + 3), abscissae - abscissae.mean()], axis=1)
    turn = np.linalg.qr(lines, mode="complete")[0]  # two columns of lines, then their complement
    system = turn.T @ gram @ turn
    bent = turn[:, 2:]
    system[2:, 2:] += ratio * 256.0 ** (3 * spar - 1) * (bent.T @ rough @ bent)
    scale = 1 / np.sqrt(np.diag(system))
    coef = turn @ (scale * np.linalg.solve(scale[:, None] * system * scale, scale * (turn.T @ rhs)))
    return np.stack([coef[i : i + 4] @ pieces[i] for i in range(m)])


def smooth_curve(
    df: DataFrame,
    response: str,
    term: str,
    spar: float = 0.1,
    keys: Sequence[str] = (),
) -> DataFrame:
    """K2: cubic smoothing-spline fitted values at the unique term values.

    Responses are averaged per unique x (weights = counts).  Knots lie at order
    statistics of the unique x, at every one below 50, so they follow the data
    however uneven it is.  Curves with fewer than four unique x keep their means.

    Plan: one aggregation gives the unique points, a scan over their ranges the
    rank per curve; the interval of a point follows from its rank.  Eleven sums per interval go to
    one small solve per curve (``applyInPandas`` over intervals, never points),
    whose cubic pieces are joined back for evaluation.  Nothing is collected.
    """
    x, y = F.col(term).cast("double"), F.col(response).cast("double")
    gkey = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("_all"))
    pts = (
        df.where(x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y))
        .groupBy(gkey.alias("_g"), x.alias("_x"))
        .agg(F.count(F.lit(1)).cast("double").alias("_w"), F.avg(y).alias("_ybar"))
    )
    # several jobs read the unique points: compute them once (shared checkpoint folder)
    ranked = stage_table(_ranked(pts), "spline-points")
    sizes = ranked.select("_n").distinct()
    knots = sizes.select("_n", _n_knots_column(F.col("_n")).alias("_k"))
    located = ranked.where(F.col("_n") >= 4).join(knots, "_n")
    # knot j (from 0) is the point of rank 1 + floor(j (n - 1) / (k - 1))
    rank_of = lambda j: F.floor(j * (F.col("_n") - 1) / (F.col("_k") - 1)) + 1
    guess = F.floor((F.col("_r") - 1) * (F.col("_k") - 1) / (F.col("_n") - 1))
    located = located.withColumn("_j", guess)
    located = located.withColumn("_j", F.when(rank_of(F.col("_j") + 1) <= F.col("_r"), F.col("_j") + 1).otherwise(F.col("_j")))
    located = located.withColumn("_knot", F.col("_r") == rank_of(F.col("_j")))
    ends = located.where("_knot").withColumn("_hi", F.lead("_x").over(Window.partitionBy("_g").orderBy("_j")))
    spans = ends.where("_hi is not null").select("_g", "_j", F.col("_x").alias("_lo"), "_hi")
    # the last point closes the last interval
    located = located.withColumn("_j", F.least(F.col("_j"), F.col("_k") - 2)).join(spans, ["_g", "_j"])
    located = located.withColumn("_u", (F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    power = [F.lit(1.0)]
    for _ in range(6):
        power.append(power[-1] * F.col("_u"))
    sums = [F.sum(F.col("_w") * power[p]).alias(f"m{p}") for p in range(7)]
    sums += [F.sum(F.col("_w") * F.col("_ybar") * power[p]).alias(f"y{p}") for p in range(4)]
    moments = located.groupBy("_g", "_j", "_lo", "_hi").agg(*sums)
    # one text per curve as the group key: a struct cannot be one
    moments = moments.withColumn("_id", F.to_json("_g", {"ignoreNullFields": "false"}))

    def solve(pdf):
        import pandas as pd

        pdf = pdf.sort_values("_j")
        edges = np.append(pdf["_lo"].to_numpy(), pdf["_hi"].to_numpy()[-1])
        cubic = solve_spline(
            edges, pdf[[f"m{p}" for p in range(7)]].to_numpy(), pdf[[f"y{p}" for p in range(4)]].to_numpy(), spar
        )
        return pd.DataFrame({"_id": pdf["_id"].to_numpy(), "_j": pdf["_j"].to_numpy(), **{f"c{p}": cubic[:, p] for p in range(4)}})

    pieces = moments.drop("_g").groupBy("_id").applyInPandas(
        solve, "_id string, _j long, c0 double, c1 double, c2 double, c3 double"
    )
    tagged = located.withColumn("_id", F.to_json("_g", {"ignoreNullFields": "false"}))
    fitted = tagged.join(pieces, ["_id", "_j"])
    u = F.col("_u")
    value = F.col("c0") + u * (F.col("c1") + u * (F.col("c2") + u * F.col("c3")))
    few = ranked.where(F.col("_n") < 4).select("_g", "_x", F.col("_ybar").alias("y"))
    out = fitted.select("_g", "_x", value.alias("y")).unionByName(few)
    return out.select(*[F.col("_g")[k].alias(k) for k in keys], F.col("_x").alias("x"), "y")


def _ranked(pts: DataFrame) -> DataFrame:
    """``pts`` with ``_r``, the rank of ``_x`` in its curve ``_g``, and ``_n``, the points of the curve.

    Points are cut into ranges (``_p``) and ranked inside each; the counts of the
    earlier ranges, one row a curve and range, are carried into the rank.
    """
    ranges = pts.repartitionByRange("_g", "_x").withColumn("_p", F.spark_partition_id())
    ranges = stage_table(ranges, "spline-ranges")  # the cuts are sampled: both branches below need the same
    earlier = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranges.groupBy("_g", "_p").agg(F.count(F.lit(1)).alias("_c"))
    carried = counts.select(
        "_g",
        "_p",
        F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_c").over(Window.partitionBy("_g")).alias("_n"),
    )
    inside = F.row_number().over(Window.partitionBy("_g", "_p").orderBy("_x"))
    # curves without a key value have NULL fields in _g, never a NULL _g
    both = ranges.withColumn("_i", inside).join(carried, ["_g", "_p"])
    return both.withColumn("_r", F.col("_i") + F.col("_before")).drop("_i", "_p", "_before")


def _n_knots_column(n):
    """``n_knots`` of a column."""
    stops, counts = (50, 200, 800, 3200), (50, 100, 140, 200)
    out = F.when(n < stops[0], n.cast("double"))
    for k in range(3):
        share = (n - stops[k]) / (stops[k + 1] - stops[k])
        out = out.when(n < stops[k + 1], counts[k] * F.pow(F.lit(counts[k + 1] / counts[k]), share))
    return F.floor(out.otherwise(200 + F.pow(n - 3200, F.lit(0.2))) + 1e-9)
