"""Thresholds of curves against a plain computation, made-up curves and odd input."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import curves


def frame(spark, of):
    """of: {k: [(c, m, w)]}"""
    return spark.createDataFrame([(k, float(c), float(m), float(w)) for k, ps in of.items() for c, m, w in ps], "k string, c double, m double, w double")


def found(spark, of):
    return {r["k"]: r for r in curves.thresholds(frame(spark, of), ["k"]).collect()}


def fit(c, m, w, h):
    """Weighted squares left by a hinge at h."""
    a = np.stack([np.ones_like(c), c, np.maximum(0, c - h)], 1) * np.sqrt(w)[:, None]
    beta = np.linalg.lstsq(a, m * np.sqrt(w), rcond=None)[0]
    return float(np.sum((m * np.sqrt(w) - a @ beta) ** 2)), beta


def plain(points):
    """zero crossing, breakpoint, saturation of one curve, step by step."""
    c, m, w = np.array(sorted(points)).T
    n = len(c)
    at = [(abs(m[i + 1] - m[i]), c[i] - m[i] * (c[i + 1] - c[i]) / (m[i + 1] - m[i])) for i in range(n - 1) if m[i] < 0 <= m[i + 1] or m[i] > 0 >= m[i + 1]]
    at.sort(reverse=True)
    zero = at[0][1] if at and (len(at) == 1 or at[0][0] >= 2 * at[1][0]) else None
    bp = sat = None
    lo, hi = max(1, math.floor(0.1 * (n - 1))), min(n - 2, math.ceil(0.9 * (n - 1)))
    if n >= 5 and hi > lo:
        hs = sorted({*c[lo : hi + 1], *np.linspace(c[lo], c[hi], 121)})
        left = [fit(c, m, w, h)[0] for h in hs]
        line = fit(c, m, w, c[-1] + 1)[0]
        h = hs[int(np.argmin(left))]
        few = min((c <= h).sum(), (c > h).sum()) < 5 or min(w[c <= h].sum(), w[c > h].sum()) < 0.05 * w.sum()
        if line > 1e-12 and min(left) <= 0.9 * line and c[lo] < h < c[hi] and not few:
            bp = h
    if n >= 5:
        v = np.array([m[max(0, i - 1) : i + 2].mean() for i in range(n)])
        s = np.abs(np.gradient(v, c))
        steep = int(np.argmax(s))
        for i in range(steep + 1, n - 2):
            if (s[i : i + 3] < 0.1 * s.max()).all() and abs(v[-1] - v[i]) <= 0.25 * (v.max() - v.min()):
                a, z = max(steep, i - 4), i + 2
                hs = np.linspace(c[a], c[i], 81)
                left = np.array([fit(c[a : z + 1], m[a : z + 1], np.ones(z + 1 - a), h)[0] for h in hs])
                sat = hs[int(np.flatnonzero(left <= left.min() + 1e-9)[0])]
                break
    return zero, bp, sat


def test_same_as_plain(spark):
    rng = random.Random(3)
    of = {}
    for k in range(24):
        knee, noise = rng.uniform(0.2, 0.8), rng.choice([0.0, 0.02, 0.2])
        n = rng.randint(5, 40)
        of[str(k)] = [((i + rng.uniform(0.1, 0.9)) / n, min((i + 0.5) / n, knee) * 3 - 1 + rng.gauss(0, noise), rng.randint(1, 30)) for i in range(n)]
    rows = found(spark, of)
    seen = [0, 0, 0]
    for k, points in of.items():
        for j, (name, want) in enumerate(zip(("zero_crossing", "breakpoint", "saturation"), plain(points), strict=True)):
            got = rows[k][name]
            assert (got is None) == (want is None), (k, name, got, want)
            if want is not None:
                seen[j] += 1
                assert got == pytest.approx(want, abs=1e-6), (k, name)
    assert min(seen) >= 5


def test_known_curves(spark):
    at = [i / 20 for i in range(21)]
    rows = found(spark, {
        "knee": [(x, min(x, 0.5) - 0.25, 1) for x in at],
        "line": [(x, x - 0.31, 1) for x in at],
        "flat": [(x, 1.0, 1) for x in at],
        "wave": [(x, math.sin(12 * x), 1) for x in at],
        "late": [(x, -5.0 if x == 0 else -x * 20, 1) for x in at],  # steep at once, flat nowhere for good
        "short": [(0.0, -1.0, 1), (1.0, 1.0, 1)],
        "one": [(0.0, 1.0, 1)],
    })
    k = rows["knee"]
    assert k["breakpoint"] == pytest.approx(0.5) and k["saturation"] == pytest.approx(0.5, abs=0.03) and k["zero_crossing"] == pytest.approx(0.25)
    assert k["slope_before"] == pytest.approx(1) and k["slope_after"] == pytest.approx(0, abs=1e-9)
    assert rows["line"]["breakpoint"] is None and rows["line"]["saturation"] is None and rows["line"]["zero_crossing"] == pytest.approx(0.31) and rows["line"]["slope"] == pytest.approx(1)
    assert rows["flat"]["zero_crossing"] is None and rows["flat"]["saturation"] is None and rows["flat"]["effect_range"] == 0
    assert rows["wave"]["multiple"] and rows["wave"]["zero_crossing"] is None
    assert rows["late"]["saturation"] is None
    assert rows["short"]["zero_crossing"] == pytest.approx(0.5) and rows["short"]["bins"] == 2
    assert rows["one"]["slope"] is None and rows["one"]["bins"] == 1


def test_odd_input(spark):
    d = frame(spark, {"a": [(0, -1, 1), (1, 1, 1), (2, float("nan"), 1), (3, 9, 0)]}).unionByName(frame(spark, {"b": [(0, 1, 1)]}).withColumn("k", F.lit(None).cast("string")).withColumn("m", F.lit(None).cast("double")))
    d = d.unionByName(frame(spark, {"x": [(0, -1, 1), (1, 3, 1)]}).withColumn("k", F.lit(None).cast("string"))).withColumn("g", F.lit("clash")).withColumn("h", F.lit(1))
    rows = {r["k"]: r for r in curves.thresholds(d, ["k"]).collect()}
    assert set(rows) == {"a", None} and rows["a"]["bins"] == 2 and rows[None]["zero_crossing"] == pytest.approx(0.25)
    assert curves.thresholds(d.limit(0), ["k"]).count() == 0


def test_replicates_and_support(spark):
    rng = random.Random(5)
    rows = [("s", b, rng.random()) for b in range(60) for _ in range(20)]
    d = spark.createDataFrame([(k, b, x, 3 * min(x, 0.5) - 0.75 + rng.gauss(0, 0.05)) for k, b, x in rows], "k string, b long, x double, y double")
    bin_ = F.floor(F.col("x") * 20)
    point = curves.thresholds(curves.binned(d, ["k"], bin_, F.col("x"), F.col("y")), ["k"])
    reps = curves.replicated(d, ["k"], F.col("b"), bin_, F.col("x"), F.col("y"), 30, 1)
    again = curves.replicated(d.repartition(7), ["k"], F.col("b"), bin_, F.col("x"), F.col("y"), 30, 1)
    total = lambda r: sorted((x["rep"], x["w"]) for x in r.groupBy("rep").agg(F.sum("w").alias("w")).collect())
    assert total(reps) == total(again)
    assert np.mean([w for _, w in total(reps)]) == pytest.approx(1200, rel=0.08)
    tol = curves.crossing_tolerance(d, ["k"], F.col("x"), [i / 20 for i in range(21)])
    r = curves.supported(point, curves.thresholds(reps, ["k", "rep"]), ["k"], tol).first()
    assert r["zero_crossing_support"] == 1 and r["zero_crossing_lo"] < 0.25 < r["zero_crossing_hi"]
    assert r["breakpoint_support"] > 0.9 and r["breakpoint_lo"] <= r["breakpoint"] <= r["breakpoint_hi"] and abs(r["breakpoint"] - 0.5) < 0.05
    # a point that lies nowhere near its replicates' crossings has no support
    far = curves.supported(point.withColumn("zero_crossing", F.lit(0.9)), curves.thresholds(reps, ["k", "rep"]), ["k"], tol).first()
    assert far["zero_crossing_support"] == 0 and far["zero_crossing_lo"] is None


def test_tolerance_ignores_atoms(spark):
    d = spark.createDataFrame([(float(i),) for i in range(101)], "x double")
    t = lambda e: curves.crossing_tolerance(d, [], F.col("x"), e).first()["tolerance"]
    assert t([0.0, float(np.nextafter(0.0, 1)), 20.0, 60.0, 100.0]) == 40 and t([0.0, 1.0, 100.0]) == 50 and t([0.0]) == pytest.approx(9) and t([]) == pytest.approx(9)
