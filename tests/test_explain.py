"""Nearest rows of other groups and Shapley values against brute force; the projection against known points."""

import math
import random
from itertools import combinations
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.functions import scalars as S
from gridloom.operators import neighbours, scenario, treeshap


def nearest(spark, rows, **how):
    d = spark.createDataFrame(rows, "id long, fold int, v array<double>")
    return {r.id: (r.distance, r.neighbour, r.visited) for r in neighbours.nearest_of_other_group(d, "id", "fold", "v", **how).collect()}


def plain_nearest(rows):
    out = {}
    for i, f, v in rows:
        d = [(math.dist(v, w), j) for j, g, w in rows if g != f]
        if d:
            out[i] = min(d)
    return out


@pytest.mark.parametrize("how", [{}, {"pivots": 7, "shard": 20}, {"pivots": 1}])
def test_nearest_of_other_group(spark, how):
    r = np.random.default_rng(1)
    rows = [(i, int(r.integers(3)), [float(x) for x in r.normal(size=3)]) for i in range(300)]
    rows += [(300 + i, int(r.integers(3)), [float(x) for x in r.integers(0, 3, 3)]) for i in range(150)]  # ties and copies
    rows += [(450 + i, 1, [5.0, 5.0, 5.0]) for i in range(30)] + [(480, 2, [5.0, 5.0, 5.0])]
    got, want = nearest(spark, rows, **how), plain_nearest(rows)
    assert got.keys() == want.keys()
    for i, (d, j) in want.items():
        assert got[i][:2] == (pytest.approx(d, abs=1e-12), j)
    assert sum(v for _, _, v in got.values()) < len(rows) ** 2 or how == {"pivots": 1}


def test_few_features_are_pruned(spark):
    r = np.random.default_rng(2)
    rows = [(i, i % 5, [float(x) for x in r.uniform(size=2)]) for i in range(4000)]
    got = nearest(spark, rows)
    assert np.mean([v for _, _, v in got.values()]) < 0.08 * len(rows)


def test_visits_leave_in_pieces():
    """A row that goes to every cell is not held as often as there are cells."""
    r = np.random.default_rng(3)
    x, pivots = r.normal(size=(2000, 64)), r.normal(size=(64, 64))
    v = pa.ListArray.from_arrays(np.arange(0, x.size + 1, 64, dtype=np.int32), pa.array(x.ravel()))
    given = pa.RecordBatch.from_arrays([pa.array(np.arange(2000)), pa.array(np.arange(2000) % 5), pa.array(np.full(2000, 99.0)), pa.array(np.zeros(2000, np.int64)), v], names=["query", "grp", "best", "seen", "v"])
    cells = SimpleNamespace(value=(np.zeros(64), np.full(64, 50.0), np.full(64, np.nan)))
    sizes = [b.num_rows for b in neighbours._visits(SimpleNamespace(value=pivots), cells, False)(iter([given]))]
    assert sum(sizes) == 2000 * 63 and max(sizes) * 64 <= neighbours.ROOM


def test_visits_grow_slower_than_the_rows(spark):
    """64 pivots, however many rows, had each row visit the same share of all."""
    r = np.random.default_rng(5)
    rows = [(i, i % 5, [float(x) for x in r.uniform(size=2)]) for i in range(16000)]
    few, many = (np.mean([v for _, _, v in nearest(spark, some).values()]) for some in (rows[:1000], rows))
    assert many < 6 * few  # 16 times the rows


def lists(x):
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))


@pytest.mark.parametrize(("groups", "shift", "some"), [(5, 0.0, 0.01), (5, 50.0, 0.01), (400, 0.0, 0.01), (1, 0.0, 1.0), (5, 1e7, 1.0), (3, None, 1.0)])
def test_few_pairs_of_a_shard_are_measured_in_double_precision(monkeypatch, groups, shift, some):
    """All were, though nearly all are far beyond the nearest; the answers are those of brute force, ties and copies included."""
    r = np.random.default_rng(11)
    x = r.integers(0, 2, (2500, 24)).astype(float) if shift is None else r.normal(size=(2500, 24)) + shift
    q = np.concatenate([x[:300], r.normal(size=(50, 24)) + (shift or 0)]) + (1e7 if shift == 1e7 else 0)
    own, asks = np.arange(2500) * 7 % groups, np.arange(350) * 7 % groups
    ids = r.permutation(2500)
    rows = pa.RecordBatch.from_arrays([*(pa.array(c) for c in (ids, own, np.where(ids % 9 == 0, ids + 3000, -1), np.where(ids % 9 == 0, groups, own), np.zeros(2500))), lists(x)], names=["id1", "grp1", "id2", "grp2", "radius", "v"])
    pairs, squares = [], neighbours._squares
    monkeypatch.setattr(neighbours, "_squares", lambda a, b: pairs.append(len(a) * len(b)) or squares(a, b))
    for best in (np.full(350, np.inf), np.full(350, 1e9)):
        distance, found, visited = neighbours._Shard([rows]).nearest(q, asks, np.zeros(350), best)
        for i in range(350):
            other = np.where(own != asks[i], ids, np.where(ids % 9 == 0, ids + 3000, -1))
            d = np.where(other >= 0, np.sqrt(((x - q[i]) ** 2).sum(axis=1)), np.inf)
            assert (distance[i], found[i]) == min(zip(d.tolist(), other.tolist(), strict=True))
        assert (visited == 2500).all()
    assert sum(pairs) <= some * 2 * 350 * 2500


def test_nearest_without_other_groups_or_vectors(spark):
    assert nearest(spark, []) == {}
    assert nearest(spark, [(1, 0, [1.0]), (2, 0, [2.0])]) == {}
    bad = [(3, 1, None), (4, 1, [None]), (5, 1, [float("nan")]), (6, None, [1.0]), (None, 1, [1.0]), (7, 1, [])]
    assert nearest(spark, [(1, 0, [1.0]), (2, 1, [3.0]), *bad]) == {1: (2.0, 2, 1), 2: (2.0, 1, 1)}


def grown(r, depth, features):
    if depth == 0 or r.random() < 0.1:
        return {"leaf": r.gauss(0, 1)}
    return {"feature": r.randrange(features), "threshold": r.gauss(0, 1), "default_left": r.random() < 0.5, "left": grown(r, depth - 1, features), "right": grown(r, depth - 1, features)}


def expected(tree, counts, x, known):
    """A tree's mean over training rows, given the known features."""
    numbers = iter(counts)

    def walk(node):
        if "leaf" in node:
            return next(numbers), node["leaf"]
        (a, left), (b, right) = walk(node["left"]), walk(node["right"])
        share = a / (a + b) if a + b else 0.5
        if node["feature"] in known:
            v = x[node["feature"]]
            share = float(node["default_left"] if math.isnan(v) else v < node["threshold"])
        return a + b, share * left + (1 - share) * right

    return walk(tree)[1]


def leaf_total(tree):
    return 1 if "leaf" in tree else leaf_total(tree["left"]) + leaf_total(tree["right"])


def subset_values(trees, counts, x, n):
    return {s: sum(expected(t, c, x, set(s)) for t, c in zip(trees, counts, strict=True)) for k in range(n + 1) for s in combinations(range(n), k)}


@pytest.mark.parametrize("seed", range(4))
def test_contributions_equal_subset_sums(seed):
    r, n = random.Random(seed), 5
    trees = [grown(r, 6, n) for _ in range(3)]
    counts = [[r.randrange(0, 9) for _ in range(leaf_total(t))] for t in trees]
    x = np.array([[r.gauss(0, 1) if r.random() > 0.2 else np.nan for _ in range(n)] for _ in range(6)])
    e = treeshap.Explainer(trees, counts, 1.5, list(range(n)))
    phi, inter = e.contributions(x), e.interactions(x)
    for row in range(len(x)):
        f = subset_values(trees, counts, x[row], n)
        at = lambda s: f[tuple(sorted(s))]
        assert e.expected == pytest.approx(1.5 + at(()))
        for i in range(n):
            rest = [j for j in range(n) if j != i]
            want = sum(math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n) * (at((*s, i)) - at(s)) for k in range(n) for s in combinations(rest, k))
            assert phi[row, i] == pytest.approx(want, abs=1e-9)
            for j in rest:
                others = [k for k in rest if k != j]
                want = sum(math.factorial(k) * math.factorial(n - k - 2) / math.factorial(n - 1) / 2 * (at((*s, i, j)) - at((*s, i)) - at((*s, j)) + at(s)) for k in range(n - 1) for s in combinations(others, k))
                assert inter[row, i, j] == pytest.approx(want, abs=1e-9)
        assert inter[row].sum(axis=1) == pytest.approx(phi[row], abs=1e-9)


def test_deep_trees_with_eighteen_groups_add_up():
    r = random.Random(9)
    groups = [i % 18 for i in range(33)]
    trees = [grown(r, 6, 33) for _ in range(25)]
    counts = [[r.randrange(1, 50) for _ in range(leaf_total(t))] for t in trees]
    x = np.array([[r.gauss(0, 1) if r.random() > 0.1 else np.nan for _ in range(33)] for _ in range(200)])
    e = treeshap.Explainer(trees, counts, 30.0, groups)
    phi, inter = e.contributions(x), e.interactions(x)
    single = treeshap.Explainer(trees, counts, 30.0, list(range(33))).contributions(x)
    assert np.stack([single[:, [i for i in range(33) if groups[i] == g]].sum(axis=1) for g in range(18)], axis=1) == pytest.approx(phi, abs=1e-9)
    whole = np.array([30 + sum(expected(t, c, row, set(range(33))) for t, c in zip(trees, counts, strict=True)) for row in x])
    assert np.abs(phi.sum(axis=1) + e.expected - whole).max() < 1e-9
    assert np.abs(inter.sum(axis=2) - phi).max() < 1e-9 and np.abs(inter - inter.transpose(0, 2, 1)).max() < 1e-12


def test_leaf_counts_and_failing_additivity(spark):
    tree = {"feature": 0, "threshold": 0.0, "left": {"leaf": 1.0}, "right": {"feature": 1, "threshold": 5.0, "default_left": False, "left": {"leaf": 2.0}, "right": {"leaf": 3.0}}}
    d = spark.createDataFrame([(1, -1.0, 1.0), (2, None, 1.0), (3, 1.0, 1.0), (4, 1.0, None), (5, 0.0, 9.0)], "id long, a double, b double")
    cols = [F.col("a"), F.col("b")]
    counts = treeshap.leaf_counts(d, [tree], cols)
    assert counts == [[2, 1, 2]]
    e = treeshap.Explainer([tree], counts, 0.0, [0, 1])
    rows = treeshap.explain(d, e, ["id"], cols, predicted=scenario.ensemble([tree], 0.0, cols)).collect()
    assert len(rows) == 5
    with pytest.raises(Exception, match="miss the prediction"):
        treeshap.explain(d, e, ["id"], cols, predicted=F.col("a") * 0).collect()
    assert treeshap.mean_interactions(d.limit(0), e, "id", cols).count() == 0


def test_projection_of_known_points_and_back(spark):
    # Degrees, zone, easting and northing of a tower and of a point on a central meridian.
    d = spark.createDataFrame([(43.642567, -79.387139, 17, 630084, 4833439), (0.0, 75.0, 43, 500000, 0)], "lat double, lon double, zone int, e long, n long")
    for zone in (17, 43):
        east, north = S.utm_forward(F.col("lat"), F.col("lon"), zone)
        lat, lon = S.utm_inverse(east, north, zone)
        for r in d.filter(F.col("zone") == zone).select("*", east.alias("x"), north.alias("y"), lat.alias("lat2"), lon.alias("lon2")).collect():
            assert (r.x, r.y) == (pytest.approx(r.e, abs=1), pytest.approx(r.n, abs=1))
            assert (r.lat2, r.lon2) == (pytest.approx(r.lat, abs=1e-8), pytest.approx(r.lon, abs=1e-8))
