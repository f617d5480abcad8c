"""Every rule on rows that keep and that break it, and on odd tables."""

import json

import pytest
from pyspark.sql import functions as F

from gridloom.operators import checks


def broken(of):
    """{rule: keys of the rows that break it}; the report counts the same."""
    rows = {}
    for r in checks.violations(of).collect():
        rows.setdefault(r["rule"], []).append(tuple(json.loads(r["key"]).values()))
    for r in checks.report(of).collect():
        assert r["violations"] == len(rows.get(r["rule"], [])), r
        assert r["checked"] >= r["violations"]
    return {k: sorted(v, key=str) for k, v in rows.items()}


def names(of):
    return [r.name for c in of for r in c.rules]


CELLS = "cell_id long, row long, col long, lon double, lat double, district int"


def cells(spark, rows):
    return checks.cells(spark.createDataFrame(rows, CELLS), 10, 10, (0.0, 0.0, 1.0, 1.0), 25)


def test_cells(spark):
    good = [(r * 10 + c, r, c, c / 10, r / 10, 3) for r in range(9) for c in range(10)]
    assert broken(cells(spark, good)) == {}
    bad = [(95, 9, 4, 0.4, 0.9, 3), (101, 10, 1, 0.1, 0.9, -1), (97, 9, 7, 1.5, 0.9, 25), (98, 9, 8, float("nan"), 0.9, 24), (99, 9, 9, None, None, None), (99, 9, 9, 0.9, 0.9, 0), (None, None, None, 0.5, 0.5, 1)]
    assert broken(cells(spark, good + bad)) == {
        "cell_id_is_position": [(95,), (None,)], "cell_on_lattice": [(101,), (None,)], "cell_in_box": [(97,)], "cell_position_finite": [(98,), (99,)], "cell_district_code": [(97,), (99,)], "cell_id_unique": [(99,)],
    }
    assert "cells_have_districts" in broken(cells(spark, [(0, 0, 0, 0.0, 0.0, -1), (1, 0, 1, 0.1, 0.0, 2)]))


def test_observed(spark):
    f = spark.createDataFrame([(1, "observed", 30.0, True), (2, "modelled", 30.0, True), (3, "reconstructed", 30.0, True), (4, "observed", None, False)], "year long, tier string, level double, available boolean")
    at = "cell_id long, year long, lst double, aoa_out int, p05_off int, p95_off int"
    good = [(c, y, 30.0, c % 2, 2 * (y != 1), 1 * (y != 1)) for c in range(100) for y in (1, 2, 3)]
    of = lambda rows, frames=f: checks.observed(spark.createDataFrame(rows, at), frames, (-10, 80), (20, 40))
    assert broken(of(good)) == {}
    assert broken(of([*good, (100, 1, 99.0, 0, 0, 0)])) == {"value_plausible": [(100, 1)]}
    assert broken(of([*good, (100, 1, 30.0, 2, 0, 0), (101, 2, 30.0, None, 0, 0)])) == {"aoa_is_flag": [(100, 1), (101, 2)]}
    assert broken(of([*good, (5, 1, 30.0, 0, 0, 0)])) == {"cell_frame_unique": [(5, 1)]}
    assert broken(of([*good, (5, 9, 30.0, 0, 0, 0), (6, None, 30.0, 0, 0, 0)])) == {"frame_listed": [(9,), (None,)]}
    assert broken(of([*good, (100, 1, None, 0, 0, 3)])) == {"frame_observed_has_no_offsets": [(1,)]}
    assert broken(of([r for r in good if r[1] != 2])) == {"frame_available_has_values": [(2,)], "frame_modelled_has_interval": [(2,)]}
    # an offset on a cell without value is no interval of the frame
    flat = [(c, y, v if not (y == 3 and c == 7) else None, a, p if y != 3 or c == 7 else 0, q if y != 3 or c == 7 else 0) for c, y, v, a, p, q in good]
    assert broken(of(flat)) == {"frame_modelled_has_interval": [(3,)]}
    assert broken(of([(c, y, 33.0 if y == 1 else v, a, p, q) for c, y, v, a, p, q in good])) == {"frame_mean_near_level": [(1,)]}
    many = lambda n: [(c, y, 41.0 if y == 1 and c < n else v, a, p, q) for c, y, v, a, p, q in good]
    assert broken(of(many(6))) == {} and broken(of(many(7))) == {"observed_near_domain": [()]} and "observed_outside_domain" in broken(of(many(31)))


def test_projected_and_zones(spark):
    at = "cell_id long, scenario string, year long, p50 double, p05_off int, p25_off int, p75_off int, p95_off int, flags int"
    row = lambda c, p50=30.0, o=(30, 10, 10, 30), flags=5: (c, "a", 2050, p50, *o, flags)
    of = lambda rows: checks.projected(spark.createDataFrame(rows, at), (20, 40))
    good = [row(c) for c in range(99)]  # half the spread is 1.5: class 2
    assert broken(of(good)) == {}
    assert broken(of([*good, row(99, o=(9, 10, 10, 30), flags=2)])) == {"quantiles_ordered": [(99, "a", 2050)]}  # near an edge: its class is not judged
    assert broken(of([*good, row(99, flags=8 + 5), row(100, flags=-1, p50=None)])) == {"flag_bits": [(100, "a", 2050), (99, "a", 2050)]}
    assert broken(of([*good, row(99, flags=1)])) == {} and broken(of([*good, row(99, flags=1), row(100, flags=1)])) == {"spread_class_agrees": [("a", 2050)]}
    assert broken(of([*good, row(99, o=(255, 10, 10, 30)), row(100, o=(255, 10, 10, 30))])) == {}  # offsets at their limit
    assert broken(of([*good, *[row(c, p50=None) for c in range(99, 106)]])) == {"projection_complete": [("a", 2050)]}
    assert broken(of([*good, row(5)])) == {"projection_unique": [(5, "a", 2050)]}

    z = lambda *codes: checks.zones(spark.createDataFrame([(i, 1, c) for i, c in enumerate(codes)], "cell_id long, year long, zone int"))
    assert broken(z(0, 1, 2, 3, 255)) == {}
    assert broken(z(0, 1, 3, 4, -1, None)) == {"zone_code": [(3, 1), (4, 1), (5, 1)], "zone_occurs": [(2,)]}
    assert broken(z()) == {"zone_occurs": [(0,), (1,), (2,), (3,)]}


CENTRES = [[0.0, 0.0], [1.0, 1.0], [2.0, 2.0], [3.0, 3.0]]


def attributions(spark, change=lambda r: r, tier="observed", correction=0.0, n=120, cube=None, zone=None):
    rows = []
    for c in range(n):
        k = c % 4
        r = {"cell_id": c, "phi": [k + 0.1, k - 0.1], "pred": 30.0 + 2 * k, "oof": 30.5 + 2 * k, "obs": 30.25 + 2 * k + correction if tier != "modelled" else None, "lst": 30.25 + 2 * k, "zone": k}
        r["resid"] = None if r["obs"] is None else r["obs"] - r["oof"]
        rows.append(change(dict(r)))
    df = spark.createDataFrame([(r["cell_id"], 1, r["phi"], r["pred"], r["oof"], r["obs"], r["resid"]) for r in rows if r.get("keep", True)], "cell_id long, year long, phi array<double>, pred double, oof double, obs double, resid double")
    f = spark.createDataFrame([(1, tier, 30.0, correction)], "year long, tier string, base double, correction double")
    cube = spark.createDataFrame([(r["cell_id"], 1, r["lst"]) for r in rows], "cell_id long, year long, lst double")
    zones = spark.createDataFrame([(r["cell_id"], 1, r["zone"]) for r in rows], "cell_id long, year long, zone int")
    return broken(checks.attributions(df, f, cube, zones, CENTRES))


def only(cell, **new):
    return lambda r: r | {k: v(r) if callable(v) else v for k, v in new.items()} if r["cell_id"] == cell else r


def test_attributions(spark):
    assert attributions(spark) == {} and attributions(spark, correction=0.4) == {} and attributions(spark, tier="modelled") == {}
    at = [(7, 1)]
    assert attributions(spark, only(7, phi=lambda r: [r["phi"][0] + 0.06, r["phi"][1]])) == {"contributions_add_up": at}
    assert attributions(spark, only(7, phi=lambda r: [r["phi"][0] + 0.04, r["phi"][1]])) == {}
    assert attributions(spark, only(7, resid=9.0)) == {"residual_is_difference": at}
    assert attributions(spark, only(7, oof=None)) == {"residual_has_both": at}
    assert attributions(spark, only(7, lst=lambda r: r["lst"] + 0.02)) == {"observation_equals_cube": at}
    assert attributions(spark, only(7, lst=float("nan"))) == {"observation_gaps_equal": at}
    assert attributions(spark, only(7, keep=False)) == {"observation_gaps_equal": at}
    assert attributions(spark, only(7, obs=31.0, resid=0.5), tier="modelled") == {"residual_is_difference": at, "modelled_frame_has_no_observations": at}
    # frames out of order
    assert "prediction_follows_cube" in attributions(spark, lambda r: r | {"lst": -r["lst"]}, tier="modelled")
    turned = attributions(spark, lambda r: r | {"obs": 60 - r["obs"], "lst": 60 - r["lst"], "resid": 60 - r["obs"] - r["oof"]})
    assert turned == {"prediction_follows_observation": [(1, "observed")]}
    assert attributions(spark, lambda r: r | {"lst": -r["lst"]}, tier="modelled", n=99) == {}  # too few rows
    weak = lambda r: r | {"lst": r["pred"] + (r["cell_id"] * 7919 % 101 - 50) / 6, "obs": (o := r["pred"] + (r["cell_id"] * 7919 % 101 - 50) / 6), "resid": o - r["oof"]}
    assert attributions(spark, weak, tier="reconstructed") == {"prediction_follows_weakly": [(1, "reconstructed")]}
    assert attributions(spark, lambda r: r | {"zone": 0} if r["cell_id"] in (1, 2) else r) == {"zone_is_nearest_centroid": [(1, "observed")]}
    assert attributions(spark, only(1, zone=0)) == {}
    assert "frame_has_contributions" in attributions(spark, lambda r: r | {"phi": None})
    assert attributions(spark, lambda r: r | {"pred": None} if r["cell_id"] < 7 else r) == {"predictions_complete": [(1, "observed")]}
    assert attributions(spark, lambda r: r | {"phi": [1.0, float("nan")]} if r["cell_id"] < 30 else r) == {"contributions_complete": [(1, "observed")]}
    assert attributions(spark, lambda r: r | {"obs": None, "resid": None, "lst": None} if r["cell_id"] < 60 else r) == {"observed_frame_has_observations": [(1, "observed")]}


def test_series_and_fans(spark):
    at = "scope long, year long, mean double, lo double, hi double, n_cells long, hot double, coverage double"
    of = lambda *rows: broken(checks.series(spark.createDataFrame(list(rows), at), [1, 2], 10))
    a, b = (0, 1, 30.25, 30.0, 31.0, 5, 0.0, 1.0), (0, 2, None, None, None, 0, None, None)
    assert of(a, b) == {}
    assert of(a, (0, 2, 30.0, 31.0, 29.0, 11, -1.0, 1.5)) == {k: [(0, 2)] for k in ("interval_ordered", "interval_holds_mean", "cell_count", "hot_area", "coverage_share")}
    assert of(a, (0, 2, 30.255, 30.0, 31.0, None, None, None)) == {"mean_has_two_decimals": [(0, 2)], "cell_count": [(0, 2)]}
    assert of(a, (0, 3, 30.0, 30.0, 30.0, 1, 0.0, 0.0)) == {"scope_has_frame": [(0, 2)], "scope_frame_listed": [(0, 3)]}
    assert of(a, b, b) == {"scope_frame_unique": [(0, 2)]}

    at = "scope long, scenario string, year long, p05 double, p25 double, p50 double, p75 double, p95 double, baseline double, total double, parts array<double>"
    fan = lambda *x: broken(checks.fans(spark.createDataFrame([(0, "a", 2050, *[float(v) if isinstance(v, int) else v for v in x])], at)))
    ok = [0.5, 0.25, 0.25, 0.0]
    assert fan(1, 2, 3, 4, 5, 2.5, 0.51, ok) == {} and fan(None, 2, 1, 4, 5, None, None, None) == {} and fan(1, 1, 1, 1, 1, 0.0, 1.0, [0.0] * 4) == {}
    at_ = [(0, "a", 2050)]
    assert fan(1, 2, 1.5, 4, 5, 1.0, 0.5, ok) == {"fan_ordered": at_} and fan(1, 2, 3, 4, 5, 2.5, 0.53, ok) == {"total_is_change": at_}
    assert fan(1, 2, 3, 4, 5, float("nan"), 0.5, ok) == {"baseline_finite": at_}
    assert fan(1, 2, 3, 4, 5, 2.5, 0.5, [0.5, 0.25, 0.25, 0.02]) == {"budget_sums_to_one": at_} and fan(1, 2, 3, 4, 5, 2.5, 0.5, [1.1, -0.1, 0.0, 0.0]) == {"budget_sums_to_one": at_}
    assert fan(1, 2, 3, 4, 5, 2.5, 0.5, [0.5, None, 0.25]) == {}

    years = lambda *t: set(broken(checks.threshold_years(spark.createDataFrame([(0, "a", list(t))], "scope long, scenario string, first array<long>"), [2030, 2050, 2070])))
    assert years(2030, 2050, None) == set() and years(None, None, None) == set() and years(2030, 2030, 2070) == set()
    assert years(2050, 2030, None) == {"threshold_years_rise"} and years(None, 2050, 2070) == {"threshold_years_have_no_gap"} and years(2031, None, None) == {"threshold_year_listed"}


def test_thresholds(spark):
    base = {"k": 1, "direction": "mixed", "multiple": False}
    for n in ("zero_crossing", "breakpoint", "saturation"):
        base |= {n: 0.5, f"{n}_lo": 0.4, f"{n}_hi": 0.6, f"{n}_support": 0.8}
    kinds = {"k": "long", "direction": "string", "multiple": "boolean"}
    schema = ", ".join(f"{c} {kinds.get(c, 'double')}" for c in base)
    of = lambda **new: set(broken(checks.thresholds(spark.createDataFrame([tuple((base | new).values())], schema), ["k"])))
    assert of() == set() and of(breakpoint=None, breakpoint_lo=None, breakpoint_hi=None, breakpoint_support=None) == set()
    assert of(direction=None) == {"direction_word"} and of(multiple=True) == {"several_crossings_have_none"}
    assert of(saturation=None) == {"saturation_interval_has_point"} and of(saturation=0.7) == {"saturation_in_interval"}
    assert of(breakpoint_lo=None) == {"breakpoint_interval_ordered"} and of(zero_crossing_support=1.2) == {"zero_crossing_support_share"}


def test_empty_and_clashing(spark):
    """Empty tables break nothing and are reported; columns named like internal ones do no harm."""
    of = cells(spark, [])
    assert {r["rule"]: r["checked"] for r in checks.report(of).collect()} == dict.fromkeys(names(of), 0)
    d = spark.createDataFrame([(0, 0, 0, 0.0, 0.0, 1)], CELLS).withColumn("n0", F.lit(5)).withColumn("b0", F.lit("x")).withColumn("share", F.lit(0)).withColumn("rule", F.lit("r")).withColumn("_n", F.lit(9))
    assert broken(checks.cells(d, 10, 10, (0, 0, 1, 1), 25)) == {}


@pytest.mark.parametrize("name", ["q_check_cells", "q_check_observed", "q_check_projected", "q_check_attributions", "q_check_series"])
def test_reports_find_something(name, spark, sf):
    """The data of each query break some rules and keep others."""
    from gridloom.plans import registry

    rows = registry.queries()[name](spark, sf).collect()
    assert len({r["rule"] for r in rows}) == len(rows) and 0 < sum(r["violations"] > 0 for r in rows) < len(rows)
