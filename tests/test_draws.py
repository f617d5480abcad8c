"""Draws: the generator's moments, the copula's correlation, and picks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import draws, scenario


def test_uniform_and_normal_moments(spark):
    d = spark.range(300).withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(100))))
    u = d.select("id", "d", draws.uniform(5, 0, F.col("id"), F.col("d")).alias("u"), draws.normal(5, 2, F.col("id"), F.col("d")).alias("z")).orderBy("id", "d").collect()
    x, z = (np.array([r[c] for r in u]) for c in ("u", "z"))
    assert 0 < x.min() < 0.001 and 0.999 < x.max() < 1
    assert np.histogram(x, 10, (0, 1))[0] == pytest.approx(np.full(10, 3000), rel=0.08)
    assert (z.mean(), z.std(), (z**3).mean(), (z**4).mean()) == (pytest.approx(0, abs=0.02), pytest.approx(1, abs=0.02), pytest.approx(0, abs=0.08), pytest.approx(3, abs=0.15))
    m = z.reshape(300, 100)
    assert abs(np.corrcoef(m[:, :-1].ravel(), m[:, 1:].ravel())[0, 1]) < 0.02 and abs(np.corrcoef(m[:-1].ravel(), m[1:].ravel())[0, 1]) < 0.02


def test_normal_distribution_function(spark):
    z = [-6.0, -1.5, -0.1, 0.0, 0.3, 2.0, 5.0]
    got = [r.p for r in spark.createDataFrame([(x,) for x in z], "z double").select(draws.probability(F.col("z")).alias("p")).collect()]
    assert got == pytest.approx([0.5 * math.erfc(-x / math.sqrt(2)) for x in z], abs=1e-7)


def projected(c, rho, n, residuals):
    zero = F.lit(0.0)
    return draws.project(c, ["id"], cell=F.col("id"), block=F.col("block"), residuals=residuals, base=zero, pattern=zero, models=[1.0], betas=[1.0], rho=rho, draws=n, seed=3)


@pytest.mark.parametrize("rho", [0.0, 0.5])
def test_errors_of_a_block_correlate(spark, rho):
    levels = [float(x) for x in np.linspace(-2, 2, 401)]
    c = spark.range(80).withColumn("block", F.floor(F.col("id") / 2))
    x = np.array([r.draws for r in projected(c, rho, 200, F.array(*[F.lit(x) for x in levels])).orderBy("id").collect()])
    same, other = np.corrcoef(x[::2].ravel(), x[1::2].ravel())[0, 1], np.corrcoef(x[1:-1:2].ravel(), x[2::2].ravel())[0, 1]
    # uniform margins of a normal copula correlate by 6 / pi asin(rho / 2)
    assert same == pytest.approx(6 / math.pi * math.asin(rho / 2), abs=0.04) and abs(other) < 0.04


def test_batches_draw_as_columns_do(spark):
    c = spark.createDataFrame([(0, 4, [1.0, 2.0, 5.0]), (9, 4, []), (7, 1, None), (3, 0, [2.5])], "id long, block long, r array<double>")
    got = {r.id: r.draws for r in projected(c, 0.3, 50, F.col("r")).collect()}
    z = math.sqrt(0.3) * draws.normal(3, 0, F.col("block"), F.col("d")) + math.sqrt(0.7) * draws.normal(3, 2, F.col("id"), F.col("d"))
    rows = c.withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(50)))).select("id", "d", F.coalesce(draws.pick(F.col("r"), draws.probability(z)), F.lit(0.0)).alias("e")).collect()
    for r in rows:
        assert got[r.id][r.d - 1] == r.e
    assert set(got[9]) == set(got[7]) == {0.0} and set(got[0]) == {1.0, 2.0, 5.0}


def test_models_and_sensitivities_are_shared(spark):
    c = spark.range(5).withColumn("block", F.lit(0))
    d = draws.project(c, ["id"], cell=F.col("id"), block=F.col("block"), residuals=F.lit(None).cast("array<double>"), base=F.col("id") * 1.0, pattern=F.lit(2.0), models=[1.0, 3.0], betas=[0.5, 1.0, 2.0], rho=0.0, draws=60, seed=1)
    x = np.array([r.draws for r in d.orderBy("id").collect()]) - np.arange(5)[:, None]
    assert (x == x[0]).all() and set(x[0]) == {2 * m * b for m in (1, 3) for b in (0.5, 1, 2)}


def test_picks(spark):
    d = spark.createDataFrame([([1.0, 2.0, 3.0], 0.0), ([1.0, 2.0, 3.0], 0.34), ([1.0, 2.0, 3.0], 1.0), ([], 0.5), (None, 0.5)], "v array<double>, u double")
    assert [r.p for r in d.select(draws.pick(F.col("v"), F.col("u")).alias("p")).collect()] == [1.0, 2.0, 3.0, None, None]


def test_monte_carlo_quantiles_of_any_id(spark):
    d = spark.createDataFrame([(-3, 10.0, 2.0), (5, 0.0, 1.0)], "cell_id long, base double, spread double")
    got = {r.cell_id: r for r in scenario.monte_carlo(d, 4000, 7).collect()}
    assert (got[-3].p05, got[-3].p50, got[-3].p95) == (pytest.approx(10 - 3.29, abs=0.2), pytest.approx(10, abs=0.15), pytest.approx(10 + 3.29, abs=0.2))
    assert got[5].p95 - got[5].p05 == pytest.approx(3.29, abs=0.15)
    assert scenario.monte_carlo(d.limit(0), 10, 7).count() == 0
