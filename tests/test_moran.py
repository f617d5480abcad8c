"""Permutations are bijections that look random; the test's numbers against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import moran, spatial


@pytest.mark.parametrize("n", [1, 2, 7, 100, 1000])
def test_every_key_is_a_bijection(spark, n):
    d = spark.range(n).withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(1, 6)]))).withColumn("to", moran.permuted(F.col("id"), F.col("k"), F.lit(n).cast("long")))
    got = {}
    for r in d.collect():
        got.setdefault(r.k, {})[r.id] = r.to
    for p in got.values():
        assert sorted(p.values()) == list(range(n))
    if n == 1000:
        x = np.array([[p[i] for i in range(n)] for p in got.values()])
        assert all(abs(np.corrcoef(a, np.arange(n))[0, 1]) < 0.12 for a in x)
        assert abs(np.corrcoef(x[0], x[1])[0, 1]) < 0.12 and (x[0] == x[1]).sum() < 10
        assert (np.abs(np.diff(x, axis=1)) <= 2).mean() < 0.02  # neighbours part


def test_same_as_numpy(spark):
    r = np.random.default_rng(1)
    h, w, perms = 9, 8, 49
    x = np.cumsum(r.normal(size=(h, w)), axis=0)
    d = spark.createDataFrame([(i * w + j, i, j, float(x[i, j])) for i in range(h) for j in range(w)], "cell_id long, row long, col long, v double")
    edges = spatial.lattice_pairs(d, 1, ["cell_id"])
    got = moran.moran_test(d, edges, "cell_id", "v", perms).first()
    at = {(q.id, q.k): q.to for q in spark.range(h * w).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(perms)))).withColumn("to", moran.permuted(F.col("id"), F.col("k"), F.lit(h * w).cast("long"))).collect()}
    near = {}
    for e in edges.select("cell_id", "cell_id_b").collect():
        near.setdefault(e.cell_id, []).append(e.cell_id_b)
    z = x.ravel() - x.mean()
    i_of = lambda z: sum(z[i] * np.mean(z[n]) for i, n in near.items()) / (z @ z)
    sims = np.array([i_of(z[[at[i, k] for i in range(h * w)]]) for k in range(1, perms + 1)])
    larger = int((sims >= i_of(z)).sum())
    larger = min(larger, perms - larger)
    assert got.moran_i == pytest.approx(i_of(z)) and got.larger == larger
    assert (got.z, got.p) == (pytest.approx((i_of(z) - sims.mean()) / sims.std()), pytest.approx((larger + 1) / (perms + 1)))


def test_constant_values_have_no_test(spark):
    d = spark.createDataFrame([(i, 0, i, 2.0) for i in range(5)], "cell_id long, row long, col long, v double")
    r = moran.moran_test(d, spatial.lattice_pairs(d, 1, ["cell_id"]), "cell_id", "v", 9).first()
    assert r.n == 5 and r.moran_i is None and r.z is None and r.p is None
