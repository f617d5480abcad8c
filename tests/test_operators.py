"""Operators on small hand-made frames, against numpy or brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import scalars as S
from gridloom.operators import agg, grid, patches, regress, scenario, spatial, windows
from gridloom.sources import lstb


def lattice(spark, values):
    rows = [(i * values.shape[1] + j, i, j, None if np.isnan(v) else float(v)) for (i, j), v in np.ndenumerate(values)]
    return spark.createDataFrame(rows, "cell_id long, row long, col long, v double")


@pytest.fixture(scope="module")
def field():
    x = np.random.default_rng(3).normal(size=(9, 7))
    x[2, 3] = x[5, 5] = np.nan
    return x


@pytest.mark.parametrize("size", [3, 5])
def test_box_mean_and_std_with_holes(spark, field, size):
    h = size // 2
    d = grid.box_std(grid.box_mean(lattice(spark, field), "v", size), "v", size)
    for r in d.collect():
        box = field[max(0, r.row - h) : r.row + h + 1, max(0, r.col - h) : r.col + h + 1]
        assert r.box_mean == pytest.approx(np.nanmean(box))
        assert r.box_std == pytest.approx(np.nanstd(box), abs=1e-9)


def test_distance_is_euclidean(spark, field):
    on = np.argwhere(field > 1)
    for r in grid.distance(lattice(spark, field), F.col("v") > 1).collect():
        assert r.distance == pytest.approx(np.sqrt(((on - [r.row, r.col]) ** 2).sum(axis=1)).min())


def test_no_target_means_no_distance(spark, field):
    assert {r.distance for r in grid.distance(lattice(spark, field), F.col("v") > 99).collect()} == {None}


def test_dense_of_an_empty_table_is_empty(spark, field):
    assert grid.dense(lattice(spark, field).limit(0)).count() == 0


def test_greedy_folds_balance():
    folds = grid.greedy_folds([(1, 5), (2, 5), (3, 4), (4, 3), (5, 3)], 2)
    assert folds == {1: 0, 2: 1, 3: 0, 4: 1, 5: 1}


def test_patches_join_diagonally(spark):
    x = np.array([[1, 0, 0, 1], [0, 1, 0, 1], [0, 0, 0, 0], [1, 1, 0, 1]], float)
    p = patches.patches(lattice(spark, x).withColumn("cls", F.col("v").cast("int")).select("cell_id", "row", "col", "cls"), "cls")
    got = {r.cell_id: r.patch for r in p.filter("cls = 1").collect()}
    assert got == {0: 0, 5: 0, 3: 3, 7: 3, 12: 12, 13: 12, 15: 15}


def test_metrics_need_two_rows_and_spread(spark):
    d = spark.createDataFrame([("a", 1.0, 1.5, 1.0), ("a", 3.0, 2.5, 2.0), ("b", 1.0, 1.0, 1.0), ("c", 2.0, 1.0, 1.0), ("c", 2.0, 3.0, 1.0)], "k string, y double, p double, w double")
    got = {r.k: r for r in agg.weighted_metrics(d, ["k"], "y", "p", "w").collect()}
    assert set(got) == {"a", "c"} and got["c"].r2 is None
    y, p, w = np.array([1.0, 3.0]), np.array([1.5, 2.5]), np.array([1.0, 2.0])
    mean = (w * y).sum() / w.sum()
    assert got["a"].r2 == pytest.approx(1 - (w * (p - y) ** 2).sum() / (w * (y - mean) ** 2).sum())


def test_interpolation_has_flat_tails(spark):
    k = spark.createDataFrame([("a", 0.0, 1.0), ("a", 2.0, 4.0)], "s string, x double, y double")
    p = spark.createDataFrame([("a", -1.0), ("a", 0.0), ("a", 1.0), ("a", 2.0), ("a", 9.0), ("b", 1.0)], "s string, x double")
    lin = {(r.s, r.x): r.y for r in windows.interpolate(k, p, "s", "x", "y").collect()}
    geo = {(r.s, r.x): r.y for r in windows.interpolate(k, p, "s", "x", "y", True).collect()}
    assert lin == {("a", -1.0): 1.0, ("a", 0.0): 1.0, ("a", 1.0): 2.5, ("a", 2.0): 4.0, ("a", 9.0): 4.0, ("b", 1.0): None}
    assert geo["a", 1.0] == pytest.approx(2.0)


def test_quantize_is_half_even_and_keeps_the_missing_code_free(spark):
    d = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (None,), (1e9,), (-1e9,)], "v double")
    assert [r[0] for r in d.select(S.quantize(F.col("v"), 1.0, -32768)).collect()] == [0, 2, 2, -32768, 32767, -32767]
    c = lstb.Column("v", "i16")
    assert lstb.encode_values(np.array([0.5, 1.5, 2.5, np.nan, 1e9, -1e9]), c).tolist() == [0, 2, 2, -32768, 32767, -32767]


def test_lstb_round_trip_and_rejection():
    cols = [lstb.Column("a", "i16", 0.01), lstb.Column("b", "u8"), lstb.Column("c", "f32")]
    data = [np.array([1.25, np.nan, -3.0]), np.array([0.0, 254.0, np.nan]), np.array([0.5, np.nan, 2.0])]
    got = lstb.unpack(lstb.pack(cols, data, "t"))
    for c, x in zip(cols, data, strict=True):
        np.testing.assert_allclose(got[c.name], x, atol=0.005)
    with pytest.raises(ValueError):
        lstb.unpack(b"nope" + bytes(20))


def test_rebalance_keeps_the_simplex(spark):
    d = spark.createDataFrame([(0.9, 0.05, 0.0), (0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.2, 0.3, 0.5)], "a double, b double, c double")
    for delta in (0.3, -0.3):
        new = scenario.rebalance(["a", "b", "c"], "a", F.lit(delta))
        for r in d.select(*[new[k].alias(k) for k in "abc"]).collect():
            assert min(r) >= -1e-12 and sum(r) <= 1 + 1e-12


def test_allocation_meets_demand(spark):
    rng = np.random.default_rng(1)
    rows = [(i, i % 3, float(rng.uniform(0.1, 1)), float(rng.uniform(0.1, 1)), 2.0) for i in range(30)]
    d = scenario.allocate(spark.createDataFrame(rows, "cell_id long, g int, cap double, a double, d double"), "g", "cap", "a", "d")
    for r in d.groupBy("g").agg(F.sum("allocated").alias("s"), F.max(F.col("allocated") - F.col("cap")).alias("over")).collect():
        assert r.s == pytest.approx(2.0) and r.over <= 1e-12


def test_trees_send_nulls_to_their_default_side(spark):
    tree = {"feature": 0, "threshold": 1.0, "default_left": False, "left": {"leaf": 1.0}, "right": {"leaf": 2.0}}
    d = spark.createDataFrame([(0.5,), (1.0,), (None,)], "x double")
    assert [r[0] for r in d.select(scenario.ensemble([tree], 10.0, [F.col("x")])).collect()] == [11.0, 12.0, 12.0]


def test_shap_is_additive_and_zero_for_the_background():
    from gridloom.plans.models import BASE, TREES

    values = scenario.interventional_shap(TREES, BASE, [0, 1, 1], [0.4, 1.3, 0.2])
    phi, pred = values(np.array([[0.4, 1.3, 0.2], [0.9, 1.9, 0.7], [np.nan, 1.0, 0.1]]))
    assert np.allclose(phi[0], 0) and np.allclose(phi.sum(axis=1), pred - pred[0])


def test_auc_and_spearman_share_ties(spark):
    d = spark.createDataFrame([(1.0, 0), (2.0, 0), (2.0, 1), (3.0, 1)], "s double, y int")
    assert regress.auc(d, "s", "y").first().auc == pytest.approx(0.875)
    r = spark.createDataFrame([("k", 1.0, 2.0), ("k", 2.0, 2.0), ("k", 3.0, 5.0)], "g string, x double, y double")
    assert regress.spearman(r, "g", "x", "y").first().rho == pytest.approx(0.8660254)


def test_knn_breaks_ties_by_key(spark, field):
    got = spatial.knn(lattice(spark, field), "cell_id", 4, 2)
    near = sorted((r.rank, r.cell_id_b) for r in got.filter("cell_id = 24").collect())
    assert near == [(1, 17), (2, 23), (3, 25), (4, 31)]


def test_relational_division(spark):
    d = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 2), (3, 1)], "c int, f int")
    assert {r.c for r in agg.in_all_frames(d, "c", "f", F.lit(True), d.select("f").distinct()).collect()} == {1, 3}


def test_histogram_of_nothing_and_of_one_value(spark):
    d = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    assert agg.histogram(d.limit(0), "v", 4).count() == 0
    assert [(r.bin, r.n) for r in agg.histogram(d, "v", 4).collect()] == [(2, 2)]


def test_every_block_gets_a_fold(spark, monkeypatch):
    from gridloom.plans import geometry

    cells = spark.range(100_100).selectExpr("id cell_id", "id * 5 row", "0L col")
    monkeypatch.setattr(geometry.cube, "cells", lambda *_: cells)
    monkeypatch.setattr(geometry.cube, "observations", lambda *_: cells.select("cell_id"))
    assert geometry.q_greedy_folds(spark, "").count() == 100_100
