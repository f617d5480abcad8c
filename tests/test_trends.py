"""Trend intervals against all pairs, bootstrap replicates against drawn rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import draws, trends


def test_inversions():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 17, 64, 100):
        v = r.integers(0, max(1, n // 2) + 1, n).astype(float)
        assert trends.at_most(v) == sum(v[j] <= v[i] for i in range(n) for j in range(i + 1, n))


@pytest.mark.parametrize("kind", ["normal", "ties", "steps", "large"])
def test_selection_equals_pairs(kind):
    r = np.random.default_rng(2)
    n = 150
    x, y = np.arange(n) * 1.0, r.normal(size=n)
    if kind == "ties":
        x, y = r.integers(0, 12, n) * 1.0, r.integers(0, 6, n) * 1.0
    if kind == "steps":
        y = np.repeat([0.0, 5.0, 2.0], 50)
    if kind == "large":
        x, y = 1.7e9 + np.sort(r.uniform(0, 1e6, n)), 1e5 * r.normal(size=n)
    pairs, selected = trends.theil_sen_of(x, y, 5), trends.theil_sen_of(x, y, 5, short=0)
    assert selected == pytest.approx(pairs, rel=1e-7, abs=1e-12 if kind == "large" else 1e-9)


def test_ranks_share_their_counts(monkeypatch):
    """Counts of inversions are all the work of a long series; searched one by one, the four ranks took over 300."""
    r = np.random.default_rng(4)
    n, calls, count = 3000, [], trends.at_most
    x, y = np.sort(r.uniform(0, 90, n)), r.normal(size=n) + np.repeat(r.integers(0, 3, n // 6), 6)
    monkeypatch.setattr(trends, "at_most", lambda v: calls.append(len(v)) or count(v))
    got = trends.theil_sen_of(x, y, 5)
    assert 0 < len(calls) < 100
    assert got == pytest.approx(trends.theil_sen_of(x, y, 5, short=n), rel=1e-7)


def test_series_of_a_table(spark):
    rows = [("a", float(i), float(2 * i + (i % 3))) for i in range(30)] + [("a", None, 1.0), ("a", 3.0, float("nan"))]
    rows += [("short", float(i), 1.0) for i in range(4)] + [("one x", 1.0, float(i)) for i in range(9)] + [("flat", float(i), 2.0) for i in range(9)]
    got = {r.k: r for r in trends.theil_sen(spark.createDataFrame(rows, "k string, x double, y double"), "k", "x", "y").collect()}
    assert set(got) == {"a", "flat"} and got["a"].n == 30 and (got["flat"].slope, got["flat"].lo, got["flat"].hi) == (0, 0, 0)
    assert got["a"].lo <= got["a"].slope <= got["a"].hi and got["a"].slope == pytest.approx(2, abs=0.05)


def test_replicates_equal_drawn_rows(spark):
    r = np.random.default_rng(3)
    n, block, size = 20, 6, 40
    a, b = r.normal(size=n), r.normal(size=n)
    y = 1000 + 2 * a - b + 0.3 * r.normal(size=n)
    rows = [(7, i, float(y[i]), float(a[i]), float(b[i])) for i in range(n)]
    rows += [(1, i, 1.0, 2.0, float(i)) for i in range(9)] + [(2, i, 1.0, float(i), 1.0) for i in range(5)] + [(7, 99, None, 1.0, 1.0)]
    d = spark.createDataFrame(rows, "e long, t long, y double, a double, b double")
    got = {x.e: x for x in trends.block_bootstrap(d, "e", "t", "y", "a", "b", block=block, draws=size, seed=5).collect()}
    u = {(x.r, x.j): x.u for x in spark.range(size).withColumnRenamed("id", "r").withColumn("j", F.explode(F.array(*[F.lit(k) for k in range(4)]))).select("r", "j", draws.uniform(5, 0, F.lit(7), F.col("r") * 4096 + F.col("j")).alias("u")).collect()}
    fit = lambda i: np.linalg.lstsq(np.column_stack([np.ones(len(i)), a[i], b[i]]), y[i], rcond=None)[0][1]
    slopes = []
    for k in range(size):
        starts = [math.floor(u[k, j] * (n - block + 1)) for j in range(4)]
        slopes.append(fit(np.concatenate([s + np.arange(block) for s in starts])[:n]))
    x = got[7]
    assert (x.n, x.used, x.fallback) == (n, size, False) and x.beta == pytest.approx(fit(np.arange(n)))
    assert (x.lo, x.hi) == (pytest.approx(np.quantile(slopes, 0.025)), pytest.approx(np.quantile(slopes, 0.975)))
    for e, rows in ((1, 9), (2, 5)):
        assert (got[e].n, got[e].beta, got[e].lo, got[e].hi, got[e].used, got[e].fallback) == (rows, 1.0, 0.5, 1.5, 0, True)
