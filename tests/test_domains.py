"""Domains and lookups on small tables."""

import math

from pyspark.sql import functions as F

from gridloom.operators import domains


def test_delta_domain(spark):
    rows = [("a", c, y, float(c * (y - 1))) for c in range(30) for y in (1, 2, 3)] + [("same", c, y, 5.0) for c in range(5) for y in (1, 2)] + [("no reference", 0, 2, 1.0)]
    rows += [("a", 99, 1, float("nan")), ("a", 99, 2, 1e9), ("a", 98, 2, 1e9), ("a", 1, 2, None)]
    d = spark.createDataFrame(rows, "k string, c long, y long, v double").withColumn("n", F.lit("clash"))
    got = {r.k: (r.bound, r.n) for r in domains.delta_domain(d, "k", "c", "y", "v", 1).collect()}
    deltas = sorted(abs(c * (y - 1)) for c in range(30) for y in (2, 3))
    assert got == {"a": (deltas[math.floor(0.98 * 59)], 60)}
    assert domains.delta_domain(d.limit(0), "k", "c", "y", "v", 1).count() == 0


def test_bounds_fall_back(spark):
    nan = float("nan")
    rows = [(-3.0, 2.0, -9.0, 9.0), (None, nan, -4.0, 1.0), (None, -2.0, -9.0, 9.0), (0.0, 0.0, 0.0, 0.0), (None, None, None, None), (1.0, 1.0, 0.0, 3.0)]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, a double, b double, c double, d double")
    at = [F.col(x) for x in "abcd"]
    got = [(r.s, r.q) for r in d.select("i", domains.symmetric_bound(*at).alias("s"), domains.sequential_domain(*at).alias("q")).orderBy("i").collect()]
    assert got == [(3.0, [-3.0, 2.0]), (4.0, [-4.0, 1.0]), (2.0, [-9.0, 9.0]), (0.05, [0.0, 1.0]), (0.05, [0.0, 1.0]), (1.0, [0.0, 3.0])]


def test_metric_at(spark):
    o = spark.createDataFrame([("a", 1, 10.0, 20.0), ("a", 2, float("nan"), 21.0)], "scope string, year long, mean double, p90 double")
    p = spark.createDataFrame([("a", 2, "x", 30.0), ("a", 3, "x", 31.0)], "scope string, year long, ssp string, p50 double")
    rows = [("a", 1, "mean", "x"), ("a", 1, "dtr", None), ("a", 1, "uhi", "x"), ("a", 2, "mean", "x"), ("a", 2, "p90", "x"), ("a", 3, "mean", "x"), ("a", 3, "p90", "x"), ("a", 3, "mean", "y"), (None, 1, "mean", "x")]
    a = spark.createDataFrame(rows, "scope string, year long, metric string, ssp string").withColumn("p50", F.lit(0))
    got = {tuple(r[:4]): (r.kind, r.value) for r in domains.metric_at(a, o, p, ["mean", "p90"]).collect()}
    want = [("observed", 10.0), ("observed", 10.0), ("observed", None), ("observed", None), ("observed", 21.0), ("projected", 31.0), ("projected", None), (None, None), (None, None)]
    assert got == dict(zip(rows, want, strict=True))
