"""Levels by regression against least squares with numpy, and odd input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import levels

A = "k string, year long, x double, y double, primary boolean"
FR = "k string, frame long, first long, last long, tier string, level double, half_width double"


def test_t_quantiles(spark):
    got = {r.n: r.t for r in spark.range(1, 202).select(F.col("id").alias("n"), levels.student95(F.col("id")).alias("t")).collect()}
    assert all(got[n] > got[n + 1] for n in range(1, 201))
    assert got[10] == 1.812461 and got[60] == pytest.approx(1.670649, abs=2e-5) and got[120] == pytest.approx(1.657651, abs=2e-6)


@pytest.mark.parametrize("trend", [0.0, 0.8])
def test_same_as_least_squares(spark, trend):
    r = np.random.default_rng(2)
    years = np.arange(1980, 2004)
    x = r.normal(20, 2, len(years))
    y = 3 + 0.7 * x + trend * (years - 1990) + r.normal(0, 0.3, len(years))
    a = spark.createDataFrame([("a", int(t), float(u), float(v) if t > 1982 else None, bool(t < 2000)) for t, u, v in zip(years, x, y, strict=True)], A)
    seen = {1990: 25.0, 1995: 28.0, 2000: 27.0}
    f = spark.createDataFrame([("a", t, t - 1, t + 1, "observed", v, 0.3) for t, v in seen.items()] + [("a", 1981, 1979, 1983, "modelled", None, None), ("a", 2010, 2009, 2011, "modelled", None, None)], FR)
    got = {q.frame: q for q in levels.modelled_levels(a, f, "k", 10).collect()}

    on = years > 1982
    t, xx, yy = years[on].astype(float), x[on], y[on]
    X = np.stack([np.ones(on.sum()), xx], 1)
    beta = np.linalg.lstsq(X, yy, rcond=None)[0]
    e = yy - X @ beta
    s2 = e @ e / (len(e) - 2)
    p = t < 2000
    tc = t[p] - t[p].mean()
    slope = tc @ e[p] / (tc @ tc)
    rest = e[p] - e[p].mean() - slope * tc
    drift = slope if abs(slope) > 2 * np.sqrt(rest @ rest / (p.sum() - 2) / (tc @ tc)) else 0.0
    assert (drift != 0) == (trend != 0)
    mean_x = lambda a, b: x[(years >= a) & (years <= b)].mean()
    res = np.array([v - beta @ [1, mean_x(f - 1, f + 1)] for f, v in seen.items()])
    at = np.array(list(seen), float)
    off = lambda when: res.mean() + drift * (when - at.mean())
    var = np.var(res - off(at), ddof=1) * (1 + 1 / 3)
    x0 = np.array([1, mean_x(1979, 1983)])
    se = s2 / 4 + s2 * x0 @ np.linalg.inv(X.T @ X) @ x0 + var + (1981 - t.mean()) ** 2 * s2 / np.sum((t - t.mean()) ** 2)
    m = got[1981]
    assert m.method == "regression" and m.years == 4 and m.level == pytest.approx(beta @ x0 + off(1981), rel=1e-9) and m.half_width == pytest.approx(levels.T95[len(e) - 3] * np.sqrt(se), rel=1e-9)
    assert m.drift == pytest.approx(drift * (1981 - at.mean())) and m.error is None
    assert got[1990].level == 25.0 and got[1990].half_width == 0.3 and got[1990].error == pytest.approx(25 - beta @ [1, mean_x(1989, 1991)] - off(1990), abs=1e-9)
    assert got[2010].method == "mean of observed" and got[2010].level == pytest.approx(np.mean(list(seen.values()))) and got[2010].half_width == 1.5


def test_odd_input(spark):
    few = spark.createDataFrame([("a", y, 1.0, 2.0, True) for y in range(4)] + [("flat", y, 5.0, float(y % 2), True) for y in range(6)] + [("a", 9, float("nan"), 1.0, None)], A)
    f = spark.createDataFrame([("a", 1, 0, 2, "modelled", None, None), ("a", 2, 1, 3, "observed", 7.0, 0.1), ("flat", 1, 0, 2, "modelled", None, None), ("none", 1, 0, 2, "modelled", None, None)], FR).withColumn("n", F.lit("clash")).withColumn("fit", F.lit(1))
    got = {(q.k, q.frame): q for q in levels.modelled_levels(few.withColumn("n", F.lit(0)), f, "k", 3).collect()}
    assert got["a", 1].method == "mean of observed" and got["a", 1].level == 7.0 and got["a", 2].error is None
    assert got["flat", 1].method == "regression" and got["flat", 1].level == pytest.approx(0.5)  # a constant driver: the mean
    assert got["none", 1].method == "none" and got["none", 1].level is None and got["none", 1].half_width is None
    assert levels.modelled_levels(few.limit(0), f.limit(0), "k", 3).count() == 0
