"""Validation of a cube's tables: rules as columns, broken rules as rows.

A rule is a Boolean column that is true where it is broken, false where it holds
and null where it does not apply. All rules of a table are judged in one pass: a
report has one row for each rule whatever the data, and the broken rows keep
their keys. Rules on frames, groups or shares are rules on an aggregated table, so
only partial sums are shuffled; rules across tables are outer joins on cell and frame.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import finite

#: Tolerances, codes and floors of the rules.
WATERFALL, RESIDUAL, STEP, TOTAL = 0.05, 0.016, 0.011, 0.02
OFFSET, TIER_EDGES, ZONES, NO_ZONE = 0.05, (0.5, 1.0, 2.0), 4, 255
CORRELATION, CORRELATION_RECONSTRUCTED, AGREEMENT, LEAST_ROWS = 0.5, 0.25, 0.99, 100
OUTSIDE_WARN, OUTSIDE_ERROR, LEVEL_GAP = 0.02, 0.10, 3.0
DIRECTIONS = ("cooling", "warming", "mixed")


@dataclass(frozen=True)
class Rule:
    name: str
    bad: Column
    severity: str = "error"
    amount: Column | None = None


@dataclass(frozen=True)
class Check:
    """Rules on the rows of one table; ``keys`` name a row."""

    df: DataFrame
    keys: list[str]
    rules: list[Rule] = field(default_factory=list)


def _amount(r: Rule) -> Column:
    return r.amount.cast("double") if r.amount is not None else F.lit(None).cast("double")


def report(checks: list[Check]) -> DataFrame:
    """rule, severity, checked, violations, worst: a row for each rule, of empty tables too."""

    def one(c: Check) -> DataFrame:
        sums = [x for i, r in enumerate(c.rules) for x in (F.count(r.bad).alias(f"n{i}"), F.count_if(r.bad).alias(f"b{i}"), F.max(F.when(r.bad, _amount(r))).alias(f"w{i}"))]
        rows = [F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.col(f"n{i}").alias("checked"), F.col(f"b{i}").alias("violations"), F.col(f"w{i}").alias("worst")) for i, r in enumerate(c.rules)]
        return c.df.agg(*sums).select(F.inline(F.array(*rows)))

    return reduce(DataFrame.unionByName, map(one, checks))


def violations(checks: list[Check]) -> DataFrame:
    """rule, severity, key (JSON of the row's keys, nulls included), amount: a row for each broken rule of each row."""

    def one(c: Check) -> DataFrame:
        key = F.to_json(F.struct(*c.keys), {"ignoreNullFields": "false"}) if c.keys else F.lit("{}")
        broken = [F.when(r.bad, F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), key.alias("key"), _amount(r).alias("amount"))) for r in c.rules]
        return c.df.select(F.inline(F.filter(F.array(*broken), lambda b: b.isNotNull())))

    return reduce(DataFrame.unionByName, map(one, checks))


def _there(name: str) -> Column:
    return finite(F.col(name).cast("double")).isNotNull()


def _share(ok: Column) -> Column:
    return F.avg(F.when(ok, 1.0).otherwise(0.0))


def _unique(df: DataFrame, keys: list[str], name: str) -> Check:
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return Check(g, keys, [Rule(name, F.col("_n") > 1, amount=F.col("_n"))])


def cells(df: DataFrame, width: int, height: int, box: tuple[float, float, float, float], districts: int) -> list[Check]:
    """cell_id, row, col, lon, lat, district: identity on the lattice, position in the box, district codes (-1 for none)."""
    w, s, e, n = box
    here = _there("lon") & _there("lat")
    inside = F.col("lon").between(w - 1e-3, e + 1e-3) & F.col("lat").between(s - 1e-3, n + 1e-3)
    rows = [
        Rule("cell_on_lattice", ~F.coalesce(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1), F.lit(False))),
        Rule("cell_id_is_position", ~F.coalesce(F.col("cell_id") == F.col("row") * width + F.col("col"), F.lit(False))),
        Rule("cell_position_finite", ~here),
        Rule("cell_in_box", F.when(here, ~inside), amount=F.greatest(w - F.col("lon"), F.col("lon") - e, s - F.col("lat"), F.col("lat") - n)),
        Rule("cell_district_code", ~F.coalesce(F.col("district").between(-1, districts - 1), F.lit(False))),
    ]
    few = df.agg(F.when(F.count(F.lit(1)) > 0, _share(F.col("district") >= 0)).alias("share"))
    return [Check(df, ["cell_id"], rows), _unique(df, ["cell_id"], "cell_id_unique"), Check(few, [], [Rule("cells_have_districts", F.col("share") <= 0.9, "warning", F.col("share"))])]


def _coverage(df: DataFrame, value: str, domain: tuple[float, float], name: str) -> Check:
    out = (F.col(value) < domain[0] - 1e-6) | (F.col(value) > domain[1] + 1e-6)
    g = df.filter(_there(value)).agg(_share(out).alias("share"))
    share = F.col("share")
    return Check(g, [], [Rule(f"{name}_outside_domain", share > OUTSIDE_ERROR, amount=share), Rule(f"{name}_near_domain", F.when(share <= OUTSIDE_ERROR, share > OUTSIDE_WARN), "warning", share)])


def observed(df: DataFrame, frames: DataFrame, plausible: tuple[float, float], domain: tuple[float, float], level_gap: float = LEVEL_GAP) -> list[Check]:
    """``df``: cell_id, year, lst, aoa_out, p05_off, p95_off; ``frames``: year, tier, level, available.

    A frame without rows is judged like one without values; frames not listed are broken.
    """
    v, here = F.col("lst"), _there("lst")
    f = frames.select("year", "tier", "level", "available", F.lit(True).alias("_listed"))
    off = (F.coalesce(F.col("p05_off"), F.lit(0)) != 0) | (F.coalesce(F.col("p95_off"), F.lit(0)) != 0)
    per = df.groupBy("year").agg(F.count_if(here).alias("_n"), F.avg(F.when(here, v)).alias("_mean"), F.count_if(off).alias("_off"), F.count_if(off & here).alias("_off_here"))
    per = per.join(f, "year", "full")
    n, gap = F.coalesce("_n", F.lit(0)), F.abs(F.col("_mean") - F.col("level"))
    of = [
        Rule("frame_listed", F.col("_listed").isNull()),
        Rule("frame_available_has_values", F.when(F.col("available"), n == 0)),
        Rule("frame_mean_near_level", F.when(n > 0, gap >= level_gap), "warning", gap),
        Rule("frame_observed_has_no_offsets", F.when(F.col("tier") == "observed", F.coalesce("_off", F.lit(0)) > 0), amount=F.col("_off")),
        Rule("frame_modelled_has_interval", F.when(F.col("tier").isin("modelled", "reconstructed"), F.coalesce("_off_here", F.lit(0)) == 0), "warning"),
    ]
    rows = [Rule("value_plausible", F.when(here, (v <= plausible[0]) | (v >= plausible[1])), amount=v), Rule("aoa_is_flag", ~F.coalesce(F.col("aoa_out").isin(0, 1), F.lit(False)))]
    return [Check(df, ["cell_id", "year"], rows), _unique(df, ["cell_id", "year"], "cell_frame_unique"), Check(per, ["year"], of), _coverage(df, "lst", domain, "observed")]


def projected(df: DataFrame, domain: tuple[float, float]) -> list[Check]:
    """cell_id, scenario, year, p50, p05_off, p25_off, p75_off, p95_off (steps of 0.05, at most 255), flags (bit 0, and two bits of the spread's class)."""
    lo, hi = F.col("p05_off"), F.col("p95_off")
    half = 0.5 * (lo + hi) * OFFSET
    tier = F.size(F.filter(F.array(*[F.lit(e) for e in TIER_EDGES]), lambda e: e <= half))
    near = F.least(*[F.abs(half - e) for e in TIER_EDGES]) <= OFFSET
    off = _there("p50") & (tier != F.shiftright(F.col("flags"), 1).bitwiseAND(3)) & ~near & (F.greatest(lo, hi) < 255)
    per = df.groupBy("scenario", "year").agg(_share(off).alias("_off"), _share(_there("p50")).alias("_there"))
    rows = [
        Rule("quantiles_ordered", (lo < F.col("p25_off")) | (hi < F.col("p75_off")), amount=F.greatest(F.col("p25_off") - lo, F.col("p75_off") - hi) * OFFSET),
        Rule("flag_bits", (F.col("flags") < 0) | (F.col("flags") >= 8), amount=F.col("flags")),
    ]
    of = [Rule("spread_class_agrees", F.when(F.col("_there") > 0, F.col("_off") > 0.01), "warning", F.col("_off")), Rule("projection_complete", F.col("_there") <= 0.95, "warning", F.col("_there"))]
    return [Check(df, ["cell_id", "scenario", "year"], rows), _unique(df, ["cell_id", "scenario", "year"], "projection_unique"), Check(per, ["scenario", "year"], of), _coverage(df, "p50", domain, "projected")]


def zones(df: DataFrame) -> list[Check]:
    """cell_id, year, zone: codes 0 to 3, or 255 for none; every zone occurs."""
    codes = [F.lit(z) for z in range(ZONES)]
    seen = df.agg(F.collect_set(F.when(F.col("zone").between(0, ZONES - 1), F.col("zone"))).alias("s")).select(F.explode(F.array(*codes)).alias("zone"), "s")
    row = Rule("zone_code", ~F.coalesce(F.col("zone").between(0, ZONES - 1) | (F.col("zone") == NO_ZONE), F.lit(False)), amount=F.col("zone"))
    return [Check(df, ["cell_id", "year"], [row]), Check(seen, ["zone"], [Rule("zone_occurs", ~F.array_contains("s", F.col("zone")), "warning")])]


def attributions(df: DataFrame, frames: DataFrame, cube: DataFrame, zones: DataFrame, centroids: list[list[float]]) -> list[Check]:
    """``df``: cell_id, year, phi (array), pred, oof, obs, resid; ``frames``: year, tier, base, correction; ``cube``: cell_id, year, lst; ``zones``: cell_id, year, zone.

    Additivity, residuals, and agreement with the other tables, which finds rows or frames that are out of order:
    observations equal the cube less the frame's correction, with the same gaps; predictions follow what
    they predict; the stored zone is the nearest centroid of the contributions.
    """
    at = ["cell_id", "year"]
    j = df.select(*at, "phi", "pred", "oof", "obs", "resid", F.lit(True).alias("_here")).join(cube.select(*at, "lst", F.lit(True).alias("_cube")), at, "full")
    j = j.join(zones.select(*at, "zone"), at, "left").join(F.broadcast(frames.select("year", "tier", "base", F.coalesce("correction", F.lit(0.0)).alias("correction"))), "year", "left")  # one row a frame
    j = j.withColumn("pred", finite(F.col("pred"))).withColumn("obs", finite(F.col("obs"))).withColumn("oof", finite(F.col("oof"))).withColumn("resid", finite(F.col("resid"))).withColumn("lst", finite(F.col("lst")))
    whole = F.col("phi").isNotNull() & ~F.exists("phi", lambda x: finite(x.cast("double")).isNull())
    j = j.withColumn("_whole", whole).withColumn("_sum", F.when(whole, F.aggregate("phi", F.lit(0.0), lambda s, x: s + x.cast("double"))))
    d2 = F.array(*[F.struct(F.aggregate(F.zip_with("phi", F.array(*[F.lit(float(x)) for x in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(centroids)])
    j = j.withColumn("_nearest", F.when(whole, F.array_min(d2)["k"]))

    seen, here = F.col("tier").isin("observed", "observed-sparse", "reconstructed"), F.col("_here").isNotNull()
    both = F.col("_here").isNotNull() & F.col("_cube").isNotNull()
    fault, off = F.abs(F.col("pred") - F.col("base") - F.col("_sum")), F.abs(F.col("obs") - F.col("correction") - F.col("lst"))
    wrong = F.abs(F.col("obs") - F.col("oof") - F.col("resid"))
    rows = [
        Rule("contributions_add_up", fault > WATERFALL, amount=fault),
        Rule("residual_is_difference", wrong > RESIDUAL, amount=wrong),
        Rule("residual_has_both", F.when(F.col("resid").isNotNull(), F.col("obs").isNull() | F.col("oof").isNull())),
        Rule("modelled_frame_has_no_observations", F.when(here & (F.col("tier") == "modelled"), F.col("obs").isNotNull())),
        Rule("observation_equals_cube", F.when(seen, off > STEP + 1e-9), amount=off),
        Rule("observation_gaps_equal", F.when(seen & (both | here | F.col("lst").isNotNull()), F.col("obs").isNull() != F.col("lst").isNull())),
    ]
    pair = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    corr = lambda a, b: F.when(F.count_if(pair(a, b)) >= LEAST_ROWS, F.corr(F.when(pair(a, b), F.col(a)), F.when(pair(a, b), F.col(b))))
    zoned = F.col("_whole") & F.col("zone").isNotNull()
    per = j.groupBy("year", "tier").agg(
        F.count_if(here).alias("_n"), F.count_if(F.col("_sum").isNotNull() & F.col("pred").isNotNull()).alias("_complete"), F.count("pred").alias("_pred"), F.count_if(here & F.col("obs").isNotNull()).alias("_obs"),
        corr("pred", "lst").alias("_cube"), corr("pred", "obs").alias("_fit"), F.when(F.count_if(zoned) >= LEAST_ROWS, F.avg(F.when(zoned, (F.col("_nearest") == F.col("zone")).cast("double")))).alias("_agree"),
    )
    fit = F.when(F.isnan("_fit"), None).otherwise(F.col("_fit"))
    cubed = F.when(F.isnan("_cube"), None).otherwise(F.col("_cube"))
    floor = F.when(F.col("tier") == "reconstructed", CORRELATION_RECONSTRUCTED).otherwise(CORRELATION)
    some, share = F.col("_n") > 0, lambda c: F.col(c) / F.col("_n")
    of = [
        Rule("frame_has_contributions", F.when(some, F.col("_complete") == 0)),
        Rule("predictions_complete", F.when(some, share("_pred") <= 0.95), "warning", share("_pred")),
        Rule("contributions_complete", F.when(some, share("_complete") <= 0.8), "warning", share("_complete")),
        Rule("observed_frame_has_observations", F.when(some & F.col("tier").isin("observed", "observed-sparse"), share("_obs") <= 0.5), "warning", share("_obs")),
        Rule("prediction_follows_cube", F.when(F.col("tier") == "modelled", cubed < CORRELATION), amount=cubed),
        Rule("prediction_follows_observation", fit < floor, amount=fit),
        Rule("prediction_follows_weakly", F.when(fit >= floor, fit < CORRELATION), "warning", fit),
        Rule("zone_is_nearest_centroid", F.col("_agree") < AGREEMENT, amount=F.col("_agree")),
    ]
    return [Check(j, at, rows), Check(per, ["year", "tier"], of)]


def series(points: DataFrame, years: list[int], most_cells: int) -> list[Check]:
    """scope, year, mean, lo, hi, n_cells, hot, coverage: intervals hold their means, counts and shares are in range, each scope has each frame once."""
    rows = [
        Rule("interval_ordered", F.col("lo") > F.col("hi"), amount=F.col("lo") - F.col("hi")),
        Rule("interval_holds_mean", (F.col("mean") < F.col("lo") - STEP) | (F.col("mean") > F.col("hi") + STEP), amount=F.greatest(F.col("lo") - F.col("mean"), F.col("mean") - F.col("hi"))),
        Rule("mean_has_two_decimals", F.abs(F.round("mean", 2) - F.col("mean")) >= 1e-9),
        Rule("cell_count", ~F.coalesce(F.col("n_cells").between(0, most_cells), F.lit(False)), amount=F.col("n_cells")),
        Rule("hot_area", F.col("hot") < 0, amount=F.col("hot")),
        Rule("coverage_share", ~F.col("coverage").between(0, 1), amount=F.col("coverage")),
    ]
    wanted = points.select("scope").distinct().withColumn("year", F.explode(F.array(*[F.lit(y).cast("long") for y in years])))
    got = points.groupBy("scope", "year").agg(F.count(F.lit(1)).alias("_n"))
    both = wanted.withColumn("_w", F.lit(True)).join(got.withColumn("year", F.col("year").cast("long")), ["scope", "year"], "full")
    return [Check(points, ["scope", "year"], rows), Check(both, ["scope", "year"], [Rule("scope_has_frame", F.col("_n").isNull()), Rule("scope_frame_listed", F.col("_w").isNull()), Rule("scope_frame_unique", F.col("_n") > 1, amount=F.col("_n"))])]


def fans(df: DataFrame) -> list[Check]:
    """scope, scenario, year, p05, p25, p50, p75, p95, baseline, total, parts (array of variance shares)."""
    q = [F.col(f"p{n}") for n in ("05", "25", "50", "75", "95")]
    falls = reduce(Column.__or__, [a > b + 1e-9 for a, b in zip(q, q[1:], strict=False)])
    whole = reduce(Column.__and__, [c.isNotNull() for c in q])
    gap = F.abs(finite(F.col("p50")) - finite(F.col("baseline")) - finite(F.col("total")))
    known = F.col("parts").isNotNull() & ~F.exists("parts", lambda p: finite(p.cast("double")).isNull())
    s = F.aggregate("parts", F.lit(0.0), lambda a, p: a + p.cast("double"))
    rows = [
        Rule("fan_ordered", F.when(whole, falls)),
        Rule("total_is_change", gap > TOTAL + 1e-9, amount=gap),
        Rule("baseline_finite", F.when(F.col("baseline").isNotNull(), finite(F.col("baseline")).isNull())),
        Rule("budget_sums_to_one", F.when(known & (s > 0), (F.abs(s - 1) > 0.01) | (F.array_min("parts") < -1e-9)), amount=F.abs(s - 1)),
    ]
    return [Check(df, ["scope", "scenario", "year"], rows)]


def threshold_years(df: DataFrame, years: list[int]) -> list[Check]:
    """scope, scenario, first (years in which +1, +2, +3 are reached): listed years, never falling, no step without the one before."""
    t = F.col("first")
    got = F.filter(t, lambda y: y.isNotNull())
    rows = [
        Rule("threshold_year_listed", F.exists(got, lambda y: ~y.isin(*years))),
        Rule("threshold_years_rise", F.sort_array(got) != got),
        Rule("threshold_years_have_no_gap", F.exists(F.slice(t, F.lit(1), F.size(got)), lambda y: y.isNull())),
    ]
    return [Check(df, ["scope", "scenario"], rows)]


def thresholds(df: DataFrame, keys: list[str]) -> list[Check]:
    """Rules on the table of ``curves.supported`` with a ``direction``."""
    rows = [Rule("direction_word", ~F.coalesce(F.col("direction").isin(*DIRECTIONS), F.lit(False))), Rule("several_crossings_have_none", F.when(F.col("multiple"), F.col("zero_crossing").isNotNull()))]
    for n in ("zero_crossing", "breakpoint", "saturation"):
        p, lo, hi = F.col(n), F.col(f"{n}_lo"), F.col(f"{n}_hi")
        slack = 1e-6 * F.greatest(F.lit(1.0), F.abs(p))
        rows += [
            Rule(f"{n}_interval_ordered", (lo > hi) | (lo.isNull() != hi.isNull())),
            Rule(f"{n}_interval_has_point", F.when(lo.isNotNull() | hi.isNotNull(), p.isNull())),
            Rule(f"{n}_in_interval", (p < lo - slack) | (p > hi + slack), amount=F.greatest(lo - p, p - hi)),
            Rule(f"{n}_support_share", ~F.col(f"{n}_support").between(0, 1), amount=F.col(f"{n}_support")),
        ]
    return [Check(df, keys, rows)]
