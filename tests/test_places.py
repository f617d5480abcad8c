"""Polygons against a plain test of every point, the footprint against a full recompute."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import polygons, tiles, whatif


def holds(rings, px, py):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (x2 - x1) * (py - y1) == (y2 - y1) * (px - x1) and min(x1, x2) <= px <= max(x1, x2) and min(y1, y2) <= py <= max(y1, y2):
                return True
            if (y1 > py) != (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


@pytest.mark.parametrize("size", [1.0, 3.0, 100.0])
def test_points_in_polygons(spark, size):
    r = random.Random(1)
    shapes = {
        1: [[(0, 0), (10, 0), (10, 10), (0, 10)], [(3, 3), (6, 3), (6, 6), (3, 6)]],
        2: [[(-5, -5), (4, -5), (-5, 4)]],
        3: [[(8, 2), (14, 4), (9, 5), (15, 9), (7, 8)]],
        4: [[(r.randint(-9, 20), r.randint(-9, 20)) for _ in range(9)]],
        5: [[(1, 1), (2, 2)]],  # no area
    }
    points = [(i, float(r.randint(-10, 32)) / 2, float(r.randint(-10, 32)) / 2) for i in range(700)]
    rings = spark.createDataFrame([(k, [(float(x), float(y)) for x, y in ring]) for k, of in shapes.items() for ring in of], "polygon long, ring array<struct<x: double, y: double>>")
    p = spark.createDataFrame([*points, (1000, None, 1.0)], "id long, x double, y double")
    got = {(q.id, q.polygon) for q in polygons.containing(p, rings, "id", size).collect()}
    assert got == {(i, k) for i, x, y in points for k, of in shapes.items() if k != 5 and holds(of, x, y)}
    assert polygons.containing(p.limit(0), rings, "id", size).count() == polygons.containing(p, rings.limit(0), "id", size).count() == 0


def test_names_that_are_nearly_right(spark):
    names = [(2, "delta"), (1, "delts"), (7, "omega")]
    d = spark.createDataFrame([("delta",), ("delt",), ("omga",), ("unknown",), (None,), ("",)], "n string")
    assert [r.k for r in d.select(polygons.nearest_name(F.col("n"), names).alias("k")).collect()] == [2, 1, 7, None, None, None]


@pytest.mark.parametrize("tile", [4, 64])
def test_footprint_is_a_full_recompute(spark, tile):
    r = random.Random(2)
    old = {(i, j): (None if r.random() < 0.1 else r.random()) for i in range(14) for j in range(11) if r.random() < 0.9}
    zone = {k for k in old if 4 <= k[0] <= 6 and 3 <= k[1] <= 7}
    new = {k: (None if r.random() < 0.2 else old[k] if r.random() < 0.3 else r.random()) for k in zone}
    after = {**old, **new}

    def mean(of, k, w):
        x = [of[i, j] for i in range(k[0] - w // 2, k[0] + w // 2 + 1) for j in range(k[1] - w // 2, k[1] + w // 2 + 1) if of.get((i, j)) is not None]
        return sum(x) / len(x) if x else None

    d = spark.createDataFrame([(*k, v) for k, v in old.items()], "row long, col long, v double")
    f = d
    for w in (3, 5):
        f = f.join(tiles.box_stats(d, "v", w).select("row", "col", F.col("mean").alias(f"v_m{w}")), ["row", "col"])
    edits = spark.createDataFrame([*[(*k, v) for k, v in new.items()], (99, 99, 1.0)], "row long, col long, v double")
    got = {(q.row, q.col): q for q in whatif.footprint(f, edits, "v", (3, 5), tile=tile).collect()}
    moved = lambda a, b: (a is None) != (b is None) or (a is not None and abs(a - b) > 1e-6 * max(1, abs(a)))
    edited = {k for k in zone if old[k] != after[k]}
    for k in old:
        pairs = [(old[k], after[k]), *[(mean(old, k, w), mean(after, k, w)) for w in (3, 5)]]
        near = [True, *[any(abs(k[0] - e[0]) <= w // 2 and abs(k[1] - e[1]) <= w // 2 for e in edited) for w in (3, 5)]]
        seen = any(moved(a, b) for (a, b), n in zip(pairs, near, strict=True) if n)
        if k in zone and not seen:  # a change of rounding in the zone may count
            continue
        assert (k in got) == seen
        if seen:
            q = got[k]
            assert (q.in_zone, q.spill) == (k in zone, k not in zone)
            for (_, b), x in zip(pairs, (q.v, q.v_m3, q.v_m5), strict=True):
                assert x == (None if b is None else pytest.approx(b))
    effect = whatif.zone_effect(f, whatif.footprint(f, edits, "v", (3, 5), tile=tile), edits, F.coalesce("v", F.lit(0.0)), F.coalesce("v", F.lit(0.0))).first()
    assert effect.n_zone == len(zone) and effect.zone_mean == pytest.approx(sum((after[k] or 0) - (old[k] or 0) for k in zone) / len(zone))
    assert effect.n_spill == sum(q.spill for q in got.values()) and effect.spill_mean == pytest.approx(0)


def test_no_edit_changes_nothing(spark):
    d = spark.createDataFrame([(0, 0, 1.0, 1.0), (0, 1, 1.0, 1.0)], "row long, col long, v double, v_m3 double")
    assert whatif.footprint(d, d.select("row", "col", "v"), "v", (3,)).count() == 0
    assert whatif.footprint(d, d.select("row", "col", "v").limit(0), "v", (3,)).count() == 0
