"""Forward selection of random intercepts and fixed terms in linear mixed models (K3).

Models: ``y ~ fixed terms + (1|f1) + (1|f2) ...`` fitted by maximum likelihood.
The profiled ML deviance (Bates, Maechler, Bolker & Walker 2015, J. Stat.
Softw. 67(1)) of such a model needs only the cross-products of [X Z y].  Z is
one-hot in the factor levels, so all of them are sums over *cells* (distinct
factor-level combinations).  Spark computes every cell's n and sums of
products of the numeric columns in one aggregation over the whole table; the
driver folds cells into Z'Z, Z'X, X'X, ... and minimises the deviance over
the variance ratios theta >= 0 (one per random factor) with Nelder-Mead.

R2 marginal / conditional follow Nakagawa & Schielzeth (2013).
Limits (checked): the cells must fit the driver (MAX_CELLS); the largest
factor may have many levels (its block is diagonal), the other factors
together at most MAX_LEVELS.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_CELLS = 500_000
MAX_LEVELS = 3_000


@dataclass
class LmeSpec:
    """Parameter bundle: responses, candidate random factors and fixed terms."""

    responses: Sequence[str]
    random: Sequence[str]
    fixed: Sequence[str]
    null: str
    threshold: float = 0.05
    report_p: float = 0.05
    # "intended": add the best passing term, repeat; "compat": the literal
    # table-order rules of the analysis scripts (see select_models_compat)
    selection: str = "intended"


@dataclass
class Cells:
    """Per-cell sufficient statistics, folded on the driver."""

    factors: list[str]
    numeric: list[str]  # column order of the product matrix after the intercept
    levels: dict[str, list]  # factor -> sorted levels
    codes: np.ndarray  # cells x factors: level index
    n: np.ndarray  # cells
    sums: np.ndarray  # cells x m x m, m = 1 + len(numeric); [0] is the intercept
    total_rows: int = 0
    index: dict[str, int] = field(default_factory=dict)

    def col(self, name: str) -> int:
        return 1 + self.numeric.index(name) if name != "(Intercept)" else 0


def cell_statistics(df: DataFrame, factors: Sequence[str], numeric: Sequence[str]) -> Cells:
    """One Spark aggregation: per factor cell, n and sums of all products."""
    factors, numeric = list(factors), list(numeric)
    cols = [F.lit(1.0)] + [F.col(c).cast("double") for c in numeric]
    complete = F.lit(True)
    for c in factors:
        complete = complete & F.col(c).isNotNull()
    for c in numeric:
        complete = complete & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    m = len(cols)
    aggs = [F.count(F.lit(1)).alias("_n")]
    pairs = [(i, j) for i in range(m) for j in range(i, m) if (i, j) != (0, 0)]
    for i, j in pairs:
        aggs.append(F.sum(cols[i] * cols[j]).alias(f"_s{i}_{j}"))
    grouped = df.where(complete).groupBy(*[F.col(c).cast("string").alias(c) for c in factors]).agg(*aggs)
    rows = grouped.limit(MAX_CELLS + 1).collect()
    if len(rows) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} factor cells")
    levels = {f: sorted({r[f] for r in rows}) for f in factors}
    lookup = {f: {v: i for i, v in enumerate(lv)} for f, lv in levels.items()}
    codes = np.array([[lookup[f][r[f]] for f in factors] for r in rows], dtype=int).reshape(len(rows), len(factors))
    n = np.array([r["_n"] for r in rows], dtype=float)
    sums = np.zeros((len(rows), m, m))
    sums[:, 0, 0] = n
    for i, j in pairs:
        v = np.array([r[f"_s{i}_{j}"] for r in rows], dtype=float)
        sums[:, i, j] = v
        sums[:, j, i] = v
    return Cells(factors, numeric, levels, codes, n, sums, int(n.sum()))


@dataclass
class Fit:
    random: tuple[str, ...]
    fixed: tuple[str, ...]
    deviance: float
    npar: int
    n: int
    beta: np.ndarray
    sigma2: float
    var_random: dict[str, float]
    r2m: float
    r2c: float

    @property
    def loglik(self) -> float:
        return -0.5 * self.deviance

    @property
    def aic(self) -> float:
        return self.deviance + 2 * self.npar

    @property
    def bic(self) -> float:
        return self.deviance + self.npar * math.log(self.n)


class _Design:
    """Cross-products of one model (response, fixed columns, random factors).

    Random factors are ordered largest first.  Kept pieces: the first factor's
    level counts (its Z'Z block is diagonal), its cross-products with the
    other factors' levels and X, and the dense remainder [Z_r X]'[Z_r X].
    """

    def __init__(self, cells: Cells, response: str, fixed: Sequence[str], random: Sequence[str]):
        xi = [0] + [cells.col(f) for f in fixed]
        yi = cells.col(response)
        s = cells.sums
        self.n = cells.total_rows
        self.p = len(xi)
        self.xtx = s[:, xi][:, :, xi].sum(axis=0)
        self.xty = s[:, xi, yi].sum(axis=0)
        self.yty = s[:, yi, yi].sum()
        self.k = len(random)
        if not random:
            return
        sizes = [len(cells.levels[r]) for r in random]
        codes = [cells.codes[:, cells.factors.index(r)] for r in random]
        q1, qr = sizes[0], sum(sizes[1:])
        self.q1, self.qr = q1, qr
        # factor index of every "rest" level (for theta scaling)
        self.rest_factor = np.concatenate([np.full(sz, i + 1) for i, sz in enumerate(sizes[1:])]) if qr else np.zeros(0, int)
        offs = np.cumsum([0] + sizes[1:])
        self.n1 = np.zeros(q1)
        np.add.at(self.n1, codes[0], cells.n)
        self.z1x = np.zeros((q1, self.p))
        np.add.at(self.z1x, codes[0], s[:, 0, xi])
        self.z1y = np.zeros(q1)
        np.add.at(self.z1y, codes[0], s[:, 0, yi])
        self.z1zr = np.zeros((q1, qr))
        self.zrzr = np.zeros((qr, qr))
        self.zrx = np.zeros((qr, self.p))
        self.zry = np.zeros(qr)
        for a in range(1, self.k):
            ia = offs[a - 1] + codes[a]
            np.add.at(self.z1zr, (codes[0], ia), cells.n)
            np.add.at(self.zrx, ia, s[:, 0, xi])
            np.add.at(self.zry, ia, s[:, 0, yi])
            for b in range(1, self.k):
                ib = offs[b - 1] + codes[b]
                np.add.at(self.zrzr, (ia, ib), cells.n)

    def solve(self, theta: np.ndarray):
        """Profiled deviance, beta and sigma^2 at theta.

        [L'Z'ZL + I, L'Z'X; X'ZL, X'X] [u; beta] = [L'Z'y; X'y] with the first
        factor's diagonal block eliminated by a Schur complement.
        """
        if self.k == 0:
            beta = np.linalg.solve(self.xtx, self.xty)
            r2 = max(self.yty - beta @ self.xty, 1e-300)
            return self.n * (1 + math.log(2 * math.pi * r2 / self.n)), beta, r2 / self.n
        t1 = theta[0]
        tr = theta[self.rest_factor] if self.qr else np.zeros(0)
        d = t1 * t1 * self.n1 + 1.0
        # rows of the first block against the rest: [t1 tr Z1'Zr, t1 Z1'X]
        m1r = np.hstack([t1 * self.z1zr * tr[None, :], t1 * self.z1x])
        mrr = np.block(
            [[tr[:, None] * self.zrzr * tr[None, :] + np.eye(self.qr), tr[:, None] * self.zrx],
             [(tr[:, None] * self.zrx).T, self.xtx]]
        )
        rhs1 = t1 * self.z1y
        rhsr = np.concatenate([tr * self.zry, self.xty])
        schur = mrr - (m1r.T / d) @ m1r
        sol_r = np.linalg.solve(schur, rhsr - m1r.T @ (rhs1 / d))
        sol_1 = (rhs1 - m1r @ sol_r) / d
        logdet = float(np.log(d).sum())
        if self.qr:
            logdet += 2.0 * float(np.log(np.diag(np.linalg.cholesky(schur[: self.qr, : self.qr]))).sum())
        r2 = max(self.yty - rhs1 @ sol_1 - rhsr @ sol_r, 1e-300)
        dev = logdet + self.n * (1 + math.log(2 * math.pi * r2 / self.n))
        return dev, sol_r[self.qr :], r2 / self.n


def _nelder_mead(f, x0: np.ndarray, step: float = 0.5, iters: int = 400, tol: float = 1e-10) -> np.ndarray:
    d = len(x0)
    pts = [x0] + [x0 + step * np.eye(d)[i] for i in range(d)]
    vals = [f(p) for p in pts]
    for _ in range(iters):
        order = np.argsort(vals)
        pts = [pts[i] for i in order]
        vals = [vals[i] for i in order]
        if abs(vals[-1] - vals[0]) < tol * (1 + abs(vals[0])):
            break
        centroid = np.mean(pts[:-1], axis=0)
        xr = centroid + (centroid - pts[-1])
        fr = f(xr)
        if fr < vals[0]:
            xe = centroid + 2 * (centroid - pts[-1])
            fe = f(xe)
            pts[-1], vals[-1] = (xe, fe) if fe < fr else (xr, fr)
        elif fr < vals[-2]:
            pts[-1], vals[-1] = xr, fr
        else:
            xc = centroid + 0.5 * (pts[-1] - centroid)
            fc = f(xc)
            if fc < vals[-1]:
                pts[-1], vals[-1] = xc, fc
            else:
                pts = [pts[0]] + [pts[0] + 0.5 * (p - pts[0]) for p in pts[1:]]
                vals = [vals[0]] + [f(p) for p in pts[1:]]
    return pts[int(np.argmin(vals))]


def fit_model(cells: Cells, response: str, fixed: Sequence[str], random: Sequence[str]) -> Fit:
    """ML fit of ``response ~ fixed + (1|random...)`` from cell statistics."""
    # the factor with most levels goes first: its block is eliminated cheaply
    random = sorted(random, key=lambda r: -len(cells.levels[r]))
    rest = sum(len(cells.levels[r]) for r in random[1:])
    if rest > MAX_LEVELS:
        raise ValueError(f"{rest} levels beyond the largest factor (> {MAX_LEVELS})")
    des = _Design(cells, response, fixed, random)
    k = len(random)
    if k:
        def dev(t):
            return des.solve(np.abs(t))[0]

        best = None
        starts = (np.ones(k),) if k == 1 else (np.ones(k), np.full(k, 0.1), np.full(k, 3.0))
        for start in starts:
            t = np.abs(_nelder_mead(dev, start))
            v = dev(t)
            if best is None or v < best[1]:
                best = (t, v)
        theta = best[0]
        # the boundary theta = 0 is a legitimate optimum
        for i in range(k):
            t0 = theta.copy()
            t0[i] = 0.0
            if dev(t0) <= best[1]:
                theta, best = t0, (t0, dev(t0))
    else:
        theta = np.zeros(0)
    deviance, beta, sigma2 = des.solve(theta)
    var_random = {r: float(theta[i] ** 2 * sigma2) for i, r in enumerate(random)}
    colsum = des.xtx[0]
    n = des.n
    var_f = float((beta @ des.xtx @ beta - (colsum @ beta) ** 2 / n) / (n - 1)) if n > 1 else 0.0
    var_f = max(var_f, 0.0)
    vr = sum(var_random.values())
    total = var_f + vr + sigma2
    r2m = var_f / total if total > 0 else float("nan")
    r2c = (var_f + vr) / total if total > 0 else float("nan")
    npar = len(beta) + k + 1
    return Fit(tuple(random), tuple(fixed), float(deviance), npar, n, beta, float(sigma2), var_random, r2m, r2c)


def chi2_sf(x: float, df: int) -> float:
    """Upper tail of the chi-square distribution for integer df."""
    if df <= 0:
        return float("nan")
    if x <= 0:
        return 1.0
    h = x / 2.0
    if df % 2 == 0:
        term, total = 1.0, 1.0
        for i in range(1, df // 2):
            term *= h / i
            total += term
        return math.exp(-h) * total
    total = math.erfc(math.sqrt(h))
    # series: sum_{i=1}^{m} h^(i-1/2) / Gamma(i+1/2), m = (df-1)/2
    m = (df - 1) // 2
    acc = 0.0
    term = math.sqrt(h) / math.gamma(1.5)
    for i in range(1, m + 1):
        acc += term
        term *= h / (i + 0.5)
    return total + math.exp(-h) * acc


def _formula(fixed: Sequence[str], random: Sequence[str]) -> str:
    parts = list(fixed) + [f"(1|{r})" for r in random]
    return " + ".join(parts)


def _row(p, null_fit: Fit | None, fit: Fit):
    chisq = df_ = pval = None
    if null_fit is not None:
        chisq = max(null_fit.deviance - fit.deviance, 0.0)
        df_ = fit.npar - null_fit.npar
        pval = chi2_sf(chisq, df_)
    return {
        "Predicted": p,
        "nullmodel": _formula(null_fit.fixed, null_fit.random) if null_fit else None,
        "model": _formula(fit.fixed, fit.random),
        "npar": fit.npar,
        "AIC": fit.aic,
        "BIC": fit.bic,
        "ML": fit.loglik,
        "deviance": fit.deviance,
        "Chisq": chisq,
        "Df": df_,
        "p_value": pval,
        "R2m": fit.r2m,
        "R2c": fit.r2c,
    }


def _stage(cells, p, current: Fit, candidates: list[str], kind: str, threshold: float, rows: list):
    """Forward steps: add the passing candidate with the largest R2m, repeat."""
    remaining = list(candidates)
    while remaining:
        tried = []
        for c in reversed(remaining):  # last candidate first
            if kind == "random":
                fit = fit_model(cells, p, current.fixed, [c, *current.random])
            else:
                fit = fit_model(cells, p, [c, *current.fixed], current.random)
            row = _row(p, current, fit)
            tried.append((c, fit, row))
            rows.append(row)
        passing = [t for t in tried if t[2]["p_value"] is not None and t[2]["p_value"] < threshold]
        if not passing:
            break
        best = max(passing, key=lambda t: (t[1].r2m, -t[2]["p_value"]))
        current = best[1]
        remaining.remove(best[0])
    return current


def select_models(cells: Cells, spec: LmeSpec) -> list[dict]:
    """All candidate rows of the forward selection for every response."""
    rows: list[dict] = []
    for p in reversed(list(spec.responses)):
        base = fit_model(cells, p, [], [spec.null])
        rows.append(_row(p, None, base))
        after_random = _stage(cells, p, base, [r for r in spec.random if r != spec.null], "random", spec.threshold, rows)
        _stage(cells, p, after_random, [f for f in spec.fixed if f != p], "fixed", spec.threshold, rows)
    return rows


def select_models_compat(cells: Cells, spec: LmeSpec) -> list[dict]:
    """Rows of the scripts' selection, quirks included.

    Per response the state is the null fit, the terms still open and the rows
    accepted so far (both tests passed, in table order, the base row first).
    Each step fits the open terms, last one first; a row passes the second
    test only with the largest R2m of *all* the step's rows.  The last accepted
    row becomes the null model, terms whose name occurs in its formula close,
    and the step that brings no other null model is the stage's last.  Both
    stages start from the base model.
    """
    rows: list[dict] = []
    for p in reversed(list(spec.responses)):
        base = fit_model(cells, p, [], [spec.null])
        accepted = [base]
        rows.append(_row(p, None, base))
        for kind, terms in (("random", [r for r in spec.random if r != spec.null]), ("fixed", spec.fixed)):
            null, left = base, [t for t in terms if t != p]
            while left:
                step = []
                for t in reversed(left):
                    fixed, random = ([t, *null.fixed], null.random) if kind == "fixed" else (null.fixed, [t, *null.random])
                    step.append(fit_model(cells, p, fixed, random))
                tested = [_row(p, null, fit) for fit in step]
                rows.extend(tested)
                top = max(r["R2m"] for r in tested)
                accepted += [
                    fit
                    for fit, r in zip(step, tested, strict=True)
                    if r["p_value"] is not None and r["p_value"] < spec.threshold and r["R2m"] == top
                ]
                formula = _formula(accepted[-1].fixed, accepted[-1].random)
                if formula == _formula(null.fixed, null.random):
                    break
                null, left = accepted[-1], [t for t in left if t not in formula]
    return rows


# AIC, BIC, ML and both R2 are reported as two-decimal text, everything else exactly
_TEXT = ("AIC", "BIC", "ML", "R2m", "R2c")
REPORT_SCHEMA = (
    "Predicted string, nullmodel string, model string, npar int, AIC string, BIC string, ML string, "
    "deviance double, Chisq double, Df int, p_value double, R2m string, R2c string"
)


def _report(spark: SparkSession, rows: list[dict]) -> DataFrame:
    def cell(name, value):
        if value is None or value != value:
            return None
        if name in _TEXT:
            return f"{float(value):.2f}"
        return value if isinstance(value, str) else int(value) if name in ("npar", "Df") else float(value)

    return spark.createDataFrame([tuple(cell(k, v) for k, v in r.items()) for r in rows], REPORT_SCHEMA)


def mixed_model_select(df: DataFrame, spec: LmeSpec, all_rows: bool = False) -> DataFrame:
    """K3: model-selection report as a small DataFrame.

    Rows with p < ``spec.report_p`` (all candidate rows with ``all_rows``),
    sorted by response and descending R2m.
    """
    factors = list(dict.fromkeys([spec.null, *spec.random]))
    numeric = list(dict.fromkeys([*spec.fixed, *spec.responses]))
    cells = cell_statistics(df, factors, numeric)
    if spec.selection == "compat":
        rows = select_models_compat(cells, spec)
    elif spec.selection == "intended":
        rows = select_models(cells, spec)
    else:
        raise ValueError("selection must be 'intended' or 'compat'")
    if not all_rows:
        rows = [r for r in rows if r["p_value"] is not None and r["p_value"] < spec.report_p]
    rows.sort(key=lambda r: (r["Predicted"], -(r["R2m"] if r["R2m"] == r["R2m"] else -1e300)))
    return _report(df.sparkSession, rows)


def compare_models(
    df: DataFrame,
    response: str,
    models: Sequence[tuple[Sequence[str], Sequence[str]]],
    null: tuple[Sequence[str], Sequence[str]],
) -> DataFrame:
    """K3f: given models, each (fixed terms, random factors), tested against one null model.

    The null model's own row comes first; all fits use the rows that are
    complete in every column any of the models names.
    """
    every = [null, *models]
    factors = list(dict.fromkeys(r for _, random in every for r in random))
    numeric = list(dict.fromkeys([*(f for fixed, _ in every for f in fixed), response]))
    cells = cell_statistics(df, factors, numeric)
    base = fit_model(cells, response, *null)
    rows = [_row(response, None, base)]
    rows += [_row(response, base, fit_model(cells, response, fixed, random)) for fixed, random in models]
    return _report(df.sparkSession, rows)
