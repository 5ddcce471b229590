"""Random-intercept fits from level sums equal the dense likelihood and the general mixed model."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoframe.operators import mixed
from chronoframe.operators.random_intercept import fit_random_intercept, level_sums, random_intercept_test


def _data(spark, seed, spread):
    rng = np.random.default_rng(seed)
    group = rng.integers(0, 12, 300)
    x, z = rng.normal(size=300), rng.normal(size=300)
    y = 3 + 0.5 * x + spread * rng.normal(size=12)[group] + rng.normal(size=300)
    rows = [(int(g), float(a), float(b), float(c)) for g, a, b, c in zip(group, x, z, y, strict=True)]
    return spark.createDataFrame(rows, "g int, x double, z double, y double").repartition(3), group, x, z, y


def _dense(group, columns, y, ratio):
    same = group[:, None] == group[None, :]
    v = np.eye(len(y)) + ratio * same
    design = np.column_stack([np.ones(len(y)), *columns])
    inv = np.linalg.inv(v)
    beta = np.linalg.solve(design.T @ inv @ design, design.T @ inv @ y)
    r = y - design @ beta
    s2 = r @ inv @ r / len(y)
    return -0.5 * (len(y) * (np.log(2 * np.pi * s2) + 1) + np.linalg.slogdet(v)[1])


@pytest.mark.parametrize("seed,spread", [(1, 1.5), (2, 0.0), (3, 30.0)])
def test_fit_is_the_maximum_of_the_dense_likelihood(spark, seed, spread):
    df, group, x, z, y = _data(spark, seed, spread)
    levels, totals = level_sums(df, "y", ["x", "z"], "g")
    for fixed, columns in (((), []), (("x",), [x]), (("x", "z"), [x, z])):
        fit = fit_random_intercept(levels, totals, ["x", "z"], fixed)
        assert fit.loglik == pytest.approx(_dense(group, columns, y, fit.ratio), abs=1e-6)
        around = [fit.ratio * f + d for f in (0.5, 0.9, 1.1, 2) for d in (0, 1e-3)]
        assert all(_dense(group, columns, y, t) <= fit.loglik + 1e-6 for t in around)
        assert fit.npar == len(columns) + 3 and fit.levels == len(set(group))


def test_equals_the_general_model(spark):
    df, *_ = _data(spark, 4, 1.0)
    cells = mixed.cell_statistics(df.withColumn("g", F.col("g").cast("string")), ["g"], ["y", "x"])
    general = mixed.fit_model(cells, "y", ["x"], ["g"])
    fit = fit_random_intercept(*level_sums(df, "y", ["x"], "g"), ["x"], ["x"])
    assert fit.loglik == pytest.approx(general.loglik, abs=1e-4) and fit.npar == general.npar


def test_likelihood_ratio_and_missing_values(spark):
    df, *_ = _data(spark, 5, 1.0)
    holes = spark.createDataFrame([(1, None, 1.0, 2.0), (None, 1.0, 1.0, 1.0), (2, 1.0, float("nan"), 1.0), (3, 1.0, 1.0, None)], df.schema)
    a = [tuple(r) for r in random_intercept_test(df, "y", ["x"], "g", null=["z"]).collect()]
    b = [tuple(r) for r in random_intercept_test(df.unionByName(holes), "y", ["x"], "g", null=["z"]).collect()]
    assert [r[0] for r in a] == ["y ~ 1 + z + (1 | g)", "y ~ 1 + z + x + (1 | g)"]
    assert a[1][7] == pytest.approx(2 * (a[1][4] - a[0][4])) and a[1][8] == 1 and a[1][9] < 1e-6
    for p, q in zip(a, b, strict=True):
        assert p[:4] == q[:4] and p[4] == pytest.approx(q[4], abs=1e-6)
    with pytest.raises(ValueError):
        random_intercept_test(df.where("false"), "y", ["x"], "g")
