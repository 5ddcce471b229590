"""Scalars, curves and mixed models against hand values and brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoframe.functions.scalars import clip_values, label_text, number_text, threshold_label
from chronoframe.operators import curves, frames, mixed


def test_threshold_label(spark):
    df = spark.createDataFrame([(0.23,), (0.45,), (0.95,), (0.01,), (1.2,), (None,), (0.0,), (float("nan"),)], "x double")
    out = [r[0] for r in df.select(threshold_label("x", [0, 0.1, 0.5, 1], ["none", "low", "mid", "high"])).collect()]
    assert out == ["mid", "mid", "high", "low", None, None, "none", None]
    # unsorted levels, duplicate level -> first label
    df2 = spark.createDataFrame([(0.5,)], "x double")
    assert df2.select(threshold_label("x", [1, 0.5, 0.5], ["a", "b", "c"])).first()[0] == "b"


def test_clip(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (0.5,), (1.0,), (2.0,), (None,), (float("nan"),)], "x double")
    out = [r[0] for r in df.select(clip_values("x")).collect()]
    assert out == [0.0, 0.0, 0.5, 1.0, 1.0, None, None]


def test_label_text(spark):
    df = spark.createDataFrame([("v2.0", 2.0, None, 7)], "a string, b double, c double, d long")
    assert df.select(label_text(df, "a", "b", "c", "d")).first()[0] == "v2.0 2 NA 7"


def test_number_text(spark):
    cases = {
        0.1 + 0.2: "0.3", 2.0: "2", -2.5: "-2.5", 100000.0: "1e+05", 123456.0: "123456", 0.0001: "1e-04",
        0.00012: "0.00012", 1 / 3: "0.333333333333333", 1e15: "1e+15", 123456789012.0: "123456789012", 0.0: "0",
        1.5e-10: "1.5e-10", 12345678901234567.0: "12345678901234568", 1e-300: "1e-300",
        float("inf"): "Inf", float("nan"): "NaN",
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "x double, want string")
    for r in df.select("x", "want", number_text("x").alias("got")).collect():
        assert r["got"] == r["want"], r


def test_linear_curve_grid(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 5.0)], "x double, y double")
    rows = curves.linear_curve(df, "y", "x").collect()
    assert len(rows) == 101
    for r in rows:
        assert r["y"] == pytest.approx(2 * r["x"] + 1)
    assert min(r["x"] for r in rows) == 1.0 and max(r["x"] for r in rows) == 2.0


def test_fill_down_with_default(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([None, 1.0, None, 0.0, None])], "t long, v double")
    df = df.withColumn("ts", F.timestamp_seconds("t").cast("timestamp_ntz")).withColumn("k", F.lit(1))
    for grains in [(), ("second",), ("second", "minute")]:
        out = frames.fill_down(df, ["v"], ["k"], "ts", "t", grains, default=0.0)
        assert [r["v"] for r in out.orderBy("t").collect()] == [0.0, 1.0, 1.0, 0.0, 0.0]


def test_time_spine_lengths(spark):
    spans = spark.createDataFrame(
        [("a", 0), ("b", 2), ("c", None), ("d", -1), ("e", 10000)], "Participant string, total_time int"
    ).withColumn("time_start", F.lit("2022-01-01 10:00:00").cast("timestamp_ntz")).withColumn("Condition", F.lit("C"))
    counts = dict(frames.time_spine(spans).groupBy("Participant").count().collect())
    assert counts == {"a": 1, "b": 3, "e": 10001}


def test_smooth_curve_large_spar_is_a_line(spark):
    rng = np.random.default_rng(1)
    xs = rng.uniform(0, 10, 400)
    ys = 3 * xs + 2 + rng.normal(0, 0.1, 400)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(xs, ys)], "x double, y double")
    out = curves.smooth_curve(df, "y", "x", spar=1.5).collect()
    assert len(out) == 400
    for r in out:
        assert r["y"] == pytest.approx(3 * r["x"] + 2, abs=0.1)
    wiggly = curves.smooth_curve(df, "y", "x", spar=-0.5).collect()
    assert len(wiggly) == 400


def _data(spark, n=240, seed=0):
    rng = np.random.default_rng(seed)
    g1, g2, x = rng.integers(0, 6, n), rng.integers(0, 3, n), rng.normal(size=n)
    y = 1 + 2 * x + rng.normal(size=6)[g1] + 0.5 * rng.normal(size=3)[g2] + rng.normal(size=n)
    rows = [(f"a{a}", f"b{b}", float(u), float(v)) for a, b, u, v in zip(g1, g2, x, y)]
    return spark.createDataFrame(rows, "g1 string, g2 string, x double, y double"), g1, g2, x, y


def test_mixed_deviance_matches_dense_likelihood(spark):
    df, g1, g2, x, y = _data(spark)
    cells = mixed.cell_statistics(df, ["g1", "g2"], ["x", "y"])
    des = mixed._Design(cells, "y", ["x"], ["g1", "g2"])
    n = len(y)
    X = np.column_stack([np.ones(n), x])
    for th in [(0.0, 0.0), (0.8, 0.5), (1.5, 0.0)]:
        Z = np.hstack([np.eye(6)[g1] * th[0], np.eye(3)[g2] * th[1]])
        V = np.eye(n) + Z @ Z.T
        Vi = np.linalg.inv(V)
        b = np.linalg.solve(X.T @ Vi @ X, X.T @ Vi @ y)
        r = y - X @ b
        dense = n * math.log(2 * math.pi * (r @ Vi @ r) / n) + np.linalg.slogdet(V)[1] + n
        assert des.solve(np.array(th))[0] == pytest.approx(dense, rel=1e-10)


def test_mixed_theta_zero_is_ols(spark):
    df, g1, g2, x, y = _data(spark)
    cells = mixed.cell_statistics(df, ["g1"], ["x", "y"])
    fit = mixed.fit_model(cells, "y", ["x"], [])
    X = np.column_stack([np.ones(len(y)), x])
    beta, *_ = np.linalg.lstsq(X, y, rcond=None)
    rss = float(((y - X @ beta) ** 2).sum())
    n = len(y)
    assert fit.deviance == pytest.approx(n * (1 + math.log(2 * math.pi * rss / n)))
    assert np.allclose(fit.beta, beta)


def test_mixed_selection_report(spark):
    df, *_ = _data(spark)
    spec = mixed.LmeSpec(responses=["y"], random=["g2"], fixed=["x"], null="g1")
    rep = mixed.mixed_model_select(df, spec).collect()
    models = [r["model"] for r in rep]
    assert "x + (1|g1)" in models or any(m.startswith("x + ") for m in models)
    assert all(r["p_value"] < 0.05 for r in rep)


def test_chi2_tail():
    for df_, crit in [(1, 3.841458820694124), (2, 5.991464547107979), (3, 7.814727903251178), (4, 9.487729036781154)]:
        assert mixed.chi2_sf(crit, df_) == pytest.approx(0.05, rel=1e-9)


def test_mixed_compat_selection(spark):
    df, *_ = _data(spark, n=300, seed=3)
    spec = mixed.LmeSpec(responses=["y"], random=["g2"], fixed=["x"], null="g1", selection="compat")
    cells = mixed.cell_statistics(df, ["g1", "g2"], ["x", "y"])
    rows = mixed.select_models_compat(cells, spec)
    # base row first; every fixed candidate of the first fixed step is tried on the base model
    assert rows[0]["nullmodel"] is None and rows[0]["model"] == "(1|g1)"
    fixed_rows = [r for r in rows if r["model"].startswith("x + ")]
    assert fixed_rows and fixed_rows[0]["nullmodel"] == "(1|g1)"
    rep = mixed.mixed_model_select(df, spec).collect()
    assert all(r["p_value"] < 0.05 for r in rep)


def _basis(t, i, degree, x, order=0):
    """Textbook recursion for a B-spline (or its derivative) on knots t; the last span is closed."""
    if order:
        out = 0.0
        for k, sign in ((i, 1), (i + 1, -1)):
            width = t[k + degree] - t[k]
            if width > 0:
                out += sign * degree / width * _basis(t, k, degree - 1, x, order - 1)
        return out
    if degree == 0:
        last = t[i + 1] == t[-1] and t[i] < t[i + 1]
        return float(t[i] <= x < t[i + 1] or (last and x == t[-1]))
    out = 0.0
    if t[i + degree] > t[i]:
        out += (x - t[i]) / (t[i + degree] - t[i]) * _basis(t, i, degree - 1, x)
    if t[i + degree + 1] > t[i + 1]:
        out += (t[i + degree + 1] - x) / (t[i + degree + 1] - t[i + 1]) * _basis(t, i + 1, degree - 1, x)
    return out


def _dense_fit(xs, ys, spar):
    ux = np.unique(xs)
    k = curves.n_knots(len(ux))
    knots = ux[[math.floor(j * (len(ux) - 1) / (k - 1)) for j in range(k)]]
    t = np.concatenate([[knots[0]] * 3, knots, [knots[-1]] * 3])
    nb = k + 2
    X = np.array([[_basis(t, i, 3, v) for i in range(nb)] for v in xs])
    om = np.zeros((nb, nb))
    for a, b in zip(knots[:-1], knots[1:]):
        for z in (-1 / math.sqrt(3), 1 / math.sqrt(3)):  # exact for the square of a line
            v = np.array([_basis(t, i, 3, (a + b) / 2 + z * (b - a) / 2, 2) for i in range(nb)])
            om += np.outer(v, v) * (b - a) / 2
    xtx = X.T @ X
    ratio = np.trace(xtx[2 : nb - 3, 2 : nb - 3]) / np.trace(om[2 : nb - 3, 2 : nb - 3])
    coef = np.linalg.solve(xtx + ratio * 256.0 ** (3 * spar - 1) * om, X.T @ ys)
    return {float(v): float(np.array([_basis(t, i, 3, v) for i in range(nb)]) @ coef) for v in ux}


@pytest.mark.parametrize("points,spar", [(30, 0.3), (120, 0.4), (300, 0.6)])
def test_smooth_curve_matches_dense_numpy_fit(spark, points, spar):
    """Spark's sums per interval = a dense penalised fit on the raw points, x uneven and repeated."""
    rng = np.random.default_rng(7)
    ux = np.unique(np.round(rng.exponential(2, points), 3))
    xs = np.concatenate([ux, rng.choice(ux, 60)])
    ys = np.sin(xs) + rng.normal(0, 0.2, len(xs))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(xs, ys)], "x double, y double")
    got = {r["x"]: r["y"] for r in curves.smooth_curve(df, "y", "x", spar=spar).collect()}
    want = _dense_fit(xs, ys, spar)
    assert got.keys() == want.keys()
    assert max(abs(got[v] - want[v]) for v in want) < 1e-6


def test_smooth_curve_on_uneven_x(spark):
    """A tight cluster and one far point: little smoothing follows the data, much gives the line."""
    xs = [1.0, 1.1, 1.2, 1.3, 1.4, 1.5, 100.0]
    ys = [0.0, 1.0, 0.0, 1.0, 0.0, 1.0, 0.0]
    df = spark.createDataFrame(list(zip(xs, ys)), "x double, y double")
    close = [r["y"] for r in curves.smooth_curve(df, "y", "x", spar=-0.5).orderBy("x").collect()]
    assert np.allclose(close, ys, atol=0.01)
    line = np.polyval(np.polyfit(xs, ys, 1), xs)
    flat = [r["y"] for r in curves.smooth_curve(df, "y", "x", spar=2.0).orderBy("x").collect()]
    assert np.allclose(flat, line, atol=0.01)


def test_compare_models(spark):
    df, *_ = _data(spark)
    null, bigger = ([], ["g1"]), (["x"], ["g1"])
    rows = mixed.compare_models(df, "y", [bigger], null).collect()
    assert [r["model"] for r in rows] == ["(1|g1)", "x + (1|g1)"] and rows[0]["Chisq"] is None
    assert rows[1]["Chisq"] == pytest.approx(rows[0]["deviance"] - rows[1]["deviance"]) and rows[1]["Df"] == 1
    assert rows[1]["Chisq"] != round(rows[1]["Chisq"], 2)
    assert all(len(rows[1][c].split(".")[1]) == 2 for c in ("AIC", "BIC", "ML", "R2m", "R2c"))


def test_smooth_curve_keys_and_few_points(spark):
    rows = [(None, float(i), float(i % 3)) for i in range(9)] + [("a", 1.0, 2.0), ("a", 1.0, 4.0), ("a", 2.0, 5.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    out = curves.smooth_curve(df, "y", "x", keys=["k"]).collect()
    assert sorted((r["x"], r["y"]) for r in out if r["k"] == "a") == [(1.0, 3.0), (2.0, 5.0)]
    assert len([r for r in out if r["k"] is None]) == 9


def test_knot_counts(spark):
    ns = [4, 49, 50, 199, 200, 500, 799, 800, 3199, 3200, 10_000, 10_000_000]
    df = spark.createDataFrame([(n,) for n in ns], "n long")
    assert [r[0] for r in df.select(curves._n_knots_column(F.col("n"))).collect()] == [curves.n_knots(n) for n in ns]
    assert curves.n_knots(3200) == 200 and curves.n_knots(10_000_000) > 200


def test_smooth_curve_ranks_points_in_ranges(spark, monkeypatch):
    """One curve's unique points are ranked over several tasks; NULL keys are a curve too."""
    staged = {}
    plain = curves.stage_table

    def spy(df, name, *rest):
        staged[name] = df._jdf.queryExecution().optimizedPlan().toString(), plain(df, name, *rest)
        return staged[name][1]

    monkeypatch.setattr(curves, "stage_table", spy)
    rows = [(None if i % 5 == 0 else "a", float(i * 7 % 1000), float(i)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        curves.smooth_curve(df, "y", "x", keys=["k"]).count()
        parts = [r["n"] for r in staged["spline-ranges"][1].groupBy("_g", "_p").agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    xs = {k: sorted({x for g, x, _ in rows if g == k}) for k in (None, "a")}
    want = {(k, x, i + 1, len(v)) for k, v in xs.items() for i, x in enumerate(v)}
    plan, points = staged["spline-points"]
    assert {(r["_g"]["k"], r["_x"], r["_r"], r["_n"]) for r in points.collect()} == want
    assert len(parts) > 2 and max(parts) < len(xs["a"]) and sum(parts) == len(want)
    assert "row_number() windowspecdefinition(_g" in plan and ", _x" not in plan.split("row_number() windowspecdefinition(_g")[1].split(",")[1]


@pytest.mark.parametrize("spar", [1.5, 2.0, 2.6, 3.0, 4.0])
def test_strong_smoothing_ends_at_the_line(spark, spar):
    n = 120
    x = np.arange(n) ** 1.3
    y = 5e4 + 37.5 * x + 900 * np.sin(np.arange(n))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    got = {r["x"]: r["y"] for r in curves.smooth_curve(df, "y", "x", spar=spar).collect()}
    slope, start = np.polyfit(x, y, 1)
    worst = max(abs(got[a] - start - slope * a) for a in x)
    assert worst < (30.0 if spar < 2 else 0.05 if spar < 2.5 else 1e-4)
