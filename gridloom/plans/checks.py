"""Validation reports on the cube's tables; each query has one row for each rule, some of them broken in the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import checks, scenario
from ..sources import cube
from .models import TREES, _features
from .registry import query

R = S.fixed


def _sql(rules: list[tuple[str, str, str, str, str]]) -> str:
    """Rows of (rule, severity, table, broken, amount) as one SELECT."""
    one = "SELECT '{0}' AS rule, '{1}' AS severity, count({3}) AS checked, count(*) FILTER (WHERE {3}) AS violations, round(max({4}) FILTER (WHERE {3})::DOUBLE, 4) + 0.0 AS worst FROM {2}"
    return "\nUNION ALL ".join(one.format(*r) for r in rules)


def _reported(c):
    return checks.report(c).withColumn("worst", R(F.col("worst")))


E, W = "error", "warning"
_BOX, _HEIGHT, _DISTRICTS = (77.0, 28.0, 77.2, 28.7), 70, 20

_CELLS = f"""
WITH c AS (SELECT cell_id, row, col, 77 + col * 0.01::DOUBLE AS lon, 28 + row * 0.01::DOUBLE AS lat, CASE WHEN district < 24 THEN district ELSE -1 END AS district FROM cells),
u AS (SELECT cell_id, count(*) AS n FROM c GROUP BY 1), d AS (SELECT avg(CASE WHEN district >= 0 THEN 1.0 ELSE 0.0 END) AS share FROM c)
"""


def _cells(spark, sf):
    c = cube.cells(spark, sf)
    district = F.when(F.col("district") < 24, F.col("district")).otherwise(-1)
    return checks.cells(c.select("cell_id", "row", "col", (77 + F.col("col") * F.lit(0.01)).alias("lon"), (28 + F.col("row") * F.lit(0.01)).alias("lat"), district.alias("district")), cube.WIDTH, _HEIGHT, _BOX, _DISTRICTS)


_IN_BOX = "lon BETWEEN 76.999::DOUBLE AND 77.201::DOUBLE AND lat BETWEEN 27.999::DOUBLE AND 28.701::DOUBLE"


@query(_CELLS + _sql([
    ("cell_on_lattice", E, "c", f"(row NOT BETWEEN 0 AND {_HEIGHT - 1} OR col NOT BETWEEN 0 AND 24)", "NULL"),
    ("cell_id_is_position", E, "c", "(cell_id <> row * 25 + col)", "NULL"),
    ("cell_position_finite", E, "c", "(NOT (isfinite(lon) AND isfinite(lat)))", "NULL"),
    ("cell_in_box", E, "c", f"(NOT ({_IN_BOX}))", "greatest(77.0::DOUBLE - lon, lon - 77.2::DOUBLE, 28.0::DOUBLE - lat, lat - 28.7::DOUBLE)"),
    ("cell_district_code", E, "c", f"(district NOT BETWEEN -1 AND {_DISTRICTS - 1})", "NULL"),
    ("cell_id_unique", E, "u", "(n > 1)", "n"),
    ("cells_have_districts", W, "d", "(share <= 0.9)", "share"),
]))
def q_check_cells(spark, sf):
    """Identity, position and district codes of the cell dimension, on a box and a list of districts smaller than the data."""
    return _reported(_cells(spark, sf))


@query(_CELLS + f"""SELECT * FROM (
SELECT 'cell_on_lattice' AS rule, cell_id FROM c WHERE row NOT BETWEEN 0 AND {_HEIGHT - 1} OR col NOT BETWEEN 0 AND 24
UNION ALL SELECT 'cell_in_box', cell_id FROM c WHERE NOT ({_IN_BOX})
UNION ALL SELECT 'cell_district_code', cell_id FROM c WHERE district NOT BETWEEN -1 AND {_DISTRICTS - 1}
UNION ALL SELECT 'cell_id_unique', cell_id FROM u WHERE n > 1)""")
def q_violating_cells(spark, sf):
    """The broken rows behind the report, with their keys."""
    v = checks.violations(_cells(spark, sf)).filter("rule <> 'cells_have_districts'")
    return v.select("rule", F.get_json_object("key", "$.cell_id").cast("long").alias("cell_id"))


#: Frames with their tier, level and availability; one has no rows.
_FRAMES = """
f AS (SELECT year, CASE WHEN year <= 1993 THEN 'reconstructed' WHEN year <= 1995 THEN 'modelled' ELSE 'observed' END AS tier, 1300 + 10.0::DOUBLE * (year - 1992) AS level, year <> 1994 AS available FROM (SELECT unnest(range(1991, 1998))::BIGINT AS year))"""
_TIER = "CASE WHEN year <= 1993 THEN 'reconstructed' WHEN year <= 1995 THEN 'modelled' ELSE 'observed' END"


def _frames(spark):
    f = spark.range(1991, 1998).select(F.col("id").alias("year"))
    return f.selectExpr("year", f"{_TIER} AS tier", "1300 + 10D * (year - 1992) AS level", "year <> 1994 AS available")


@query(f"""
WITH {_FRAMES},
o AS (SELECT cell_id, year, CASE WHEN cell_id % 9 <> 0 THEN lst END AS lst, (built > 0.9)::INT + (cell_id % 500 = 0)::INT AS aoa_out, CASE WHEN year < 1997 THEN n % 4 ELSE 0 END AS p05_off, CASE WHEN year < 1996 THEN n % 3 ELSE 0 END AS p95_off FROM obs JOIN cells USING (cell_id)),
u AS (SELECT cell_id, year, count(*) AS n FROM o GROUP BY ALL),
g AS (SELECT year, count(lst) AS n, avg(lst) AS m, count(*) FILTER (WHERE p05_off <> 0 OR p95_off <> 0) AS off, count(*) FILTER (WHERE (p05_off <> 0 OR p95_off <> 0) AND lst IS NOT NULL) AS here FROM o GROUP BY year),
p AS (SELECT coalesce(n, 0) AS n, m, coalesce(off, 0) AS off, coalesce(here, 0) AS here, f.year AS listed, tier, level, available, abs(m - level) AS gap FROM g FULL JOIN f ON g.year = f.year),
d AS (SELECT avg(CASE WHEN lst < 920 - 1e-6::DOUBLE OR lst > 1850 + 1e-6::DOUBLE THEN 1.0 ELSE 0.0 END) AS share FROM o WHERE lst IS NOT NULL)
""" + _sql([
    ("value_plausible", E, "o", "(lst <= 910 OR lst >= 1880)", "lst"),
    ("aoa_is_flag", E, "o", "(aoa_out NOT IN (0, 1))", "NULL"),
    ("cell_frame_unique", E, "u", "(n > 1)", "n"),
    ("frame_listed", E, "p", "(listed IS NULL)", "NULL"),
    ("frame_available_has_values", E, "p", "(CASE WHEN available THEN n = 0 END)", "NULL"),
    ("frame_mean_near_level", W, "p", "(CASE WHEN n > 0 THEN gap >= 150 END)", "gap"),
    ("frame_observed_has_no_offsets", E, "p", "(CASE WHEN tier = 'observed' THEN off > 0 END)", "off"),
    ("frame_modelled_has_interval", W, "p", "(CASE WHEN tier IN ('modelled', 'reconstructed') THEN here = 0 END)", "NULL"),
    ("observed_outside_domain", E, "d", "(share > 0.10)", "share"),
    ("observed_near_domain", W, "d", "(CASE WHEN share <= 0.10 THEN share > 0.02 END)", "share"),
]))
def q_check_observed(spark, sf):
    """Values, flags, offsets, levels and completeness of the observed frames."""
    o = cube.observations(spark, sf).join(cube.cells(spark, sf), "cell_id")
    o = o.selectExpr("cell_id", "year", "CASE WHEN cell_id % 9 <> 0 THEN lst END AS lst", "int(built > 0.9) + int(cell_id % 500 = 0) AS aoa_out", "IF(year < 1997, n % 4, 0) AS p05_off", "IF(year < 1996, n % 3, 0) AS p95_off")
    return _reported(checks.observed(o, _frames(spark), (910, 1880), (920, 1850), 150.0))


@query("""
WITH o AS (SELECT cell_id, flag AS scenario, year, avg(v) AS p50, count(*) AS n FROM pixels GROUP BY ALL),
q AS (SELECT cell_id, scenario, year, CASE WHEN n < 3 THEN p50 END AS p50, 10 * n + cell_id % 17 AS p05_off, 12 * n AS p25_off, 8 * n AS p75_off, 10 * n + cell_id % 13 AS p95_off, 2 * (cell_id % 5) AS flags FROM o),
t AS (SELECT *, 0.5::DOUBLE * (p05_off + p95_off) * 0.05::DOUBLE AS half FROM q),
s AS (SELECT *, p50 IS NOT NULL AND (half >= 0.5)::INT + (half >= 1)::INT + (half >= 2)::INT <> (flags >> 1) & 3 AND least(abs(half - 0.5), abs(half - 1.0), abs(half - 2.0)) > 0.05::DOUBLE AND greatest(p05_off, p95_off) < 255 AS mism FROM t),
u AS (SELECT count(*) AS n FROM q GROUP BY cell_id, scenario, year),
g AS (SELECT scenario, year, avg(mism::INT) AS miss, avg((p50 IS NOT NULL)::INT) AS there FROM s GROUP BY ALL),
d AS (SELECT avg(CASE WHEN p50 < 950 - 1e-6::DOUBLE OR p50 > 1800 + 1e-6::DOUBLE THEN 1.0 ELSE 0.0 END) AS share FROM q WHERE p50 IS NOT NULL),
zn AS (SELECT cell_id, year, (cell_id + n) % 4 + CASE WHEN (cell_id + n) % 4 = 2 THEN 253 ELSE 0 END + CASE WHEN cell_id % 700 = 1 THEN 7 ELSE 0 END AS zone FROM obs),
ze AS (SELECT z, NOT EXISTS (SELECT 1 FROM zn WHERE zone = z) AS empty FROM range(4) t(z))
""" + _sql([
    ("quantiles_ordered", E, "q", "(p05_off < p25_off OR p95_off < p75_off)", "greatest(p25_off - p05_off, p75_off - p95_off) * 0.05::DOUBLE"),
    ("flag_bits", E, "q", "(flags < 0 OR flags >= 8)", "flags"),
    ("projection_unique", E, "u", "(n > 1)", "n"),
    ("spread_class_agrees", W, "g", "(CASE WHEN there > 0 THEN miss > 0.01 END)", "miss"),
    ("projection_complete", W, "g", "(there <= 0.95)", "there"),
    ("projected_outside_domain", E, "d", "(share > 0.10)", "share"),
    ("projected_near_domain", W, "d", "(CASE WHEN share <= 0.10 THEN share > 0.02 END)", "share"),
    ("zone_code", E, "zn", "(NOT (zone BETWEEN 0 AND 3 OR zone = 255))", "zone"),
    ("zone_occurs", W, "ze", "(empty)", "NULL"),
]))
def q_check_projected(spark, sf):
    """Order of the offsets, flag bits against the spread, completeness and range of projected frames, and zone codes."""
    o = cube.pixels(spark, sf).groupBy("cell_id", F.col("flag").alias("scenario"), "year").agg(F.avg("v").alias("p50"), F.count(F.lit(1)).alias("n"))
    o = o.selectExpr("cell_id", "scenario", "year", "IF(n < 3, p50, NULL) AS p50", "10 * n + cell_id % 17 AS p05_off", "12 * n AS p25_off", "8 * n AS p75_off", "10 * n + cell_id % 13 AS p95_off", "2 * (cell_id % 5) AS flags")
    code = "(cell_id + n) % 4"
    z = cube.observations(spark, sf).selectExpr("cell_id", "year", f"{code} + IF({code} = 2, 253, 0) + IF(cell_id % 700 = 1, 7, 0) AS zone")
    return _reported(checks.projected(o, (950, 1800)) + checks.zones(z))


_CENTROIDS = [[-0.4, -0.2], [0.1, 0.3], [0.7, 0.9], [0.7, -0.2]]
_NEAREST = "list_extract(list_sort([" + ", ".join(f"{{'d': (a - {x}) * (a - {x}) + (b - {y}) * (b - {y}), 'k': {k}}}" for k, (x, y) in enumerate(_CENTROIDS)) + "]), 1).k"


@query(f"""
WITH {_FRAMES},
c AS (SELECT cell_id, elev, CASE WHEN cell_id % 7 <> 0 THEN built END AS x, CASE WHEN cell_id % 11 <> 0 THEN elev / 1000 END AS y, row / 80 AS z FROM cells),
t AS (SELECT cell_id, elev, (CASE WHEN x IS NULL OR x < 0.5 THEN CASE WHEN y IS NULL OR y < 1.2 THEN -0.4 ELSE 0.1 END ELSE 0.7 END)::DOUBLE AS a, (CASE WHEN y < 1.5 THEN -0.2 WHEN z IS NULL OR z < 0.5 THEN 0.3 ELSE 0.9 END)::DOUBLE AS b FROM c),
s AS (SELECT t.*, o.year, tier, 30 + a + b + CASE WHEN t.cell_id % 83 = 0 THEN 0.06::DOUBLE ELSE 0 END AS pred, CASE WHEN tier <> 'modelled' OR t.cell_id % 600 = 0 THEN 29 + elev / 1000 + a END AS obs, {_NEAREST} AS nearest FROM t JOIN obs o USING (cell_id) JOIN f USING (year)),
r AS (SELECT *, pred + (cell_id % 5 - 2) / 10.0::DOUBLE AS oof, obs - pred - (cell_id % 5 - 2) / 10.0::DOUBLE + CASE WHEN cell_id % 301 = 0 THEN 0.02::DOUBLE ELSE 0 END AS resid,
  CASE WHEN cell_id % 211 <> 0 THEN CASE WHEN tier = 'modelled' THEN 60 - pred ELSE 29 + elev / 1000 + a - 0.1::DOUBLE END + CASE WHEN cell_id % 97 = 0 THEN 0.02::DOUBLE ELSE 0 END END AS lst, CASE WHEN cell_id % 40 = 0 THEN (nearest + 1) % 4 ELSE nearest END AS zone FROM s),
w AS (SELECT *, abs(pred - 30 - (a + b)) AS fault, abs(obs - oof - resid) AS wrong, abs(obs - 0.1::DOUBLE - lst) AS off, tier <> 'modelled' AS seen FROM r),
g AS (SELECT year, tier, count(*) AS n, count(obs) AS no, CASE WHEN count(lst) >= 100 THEN corr(pred, lst) END AS cubed, CASE WHEN count(obs) >= 100 THEN corr(pred, obs) END AS fit, CASE WHEN tier = 'reconstructed' THEN 0.25 ELSE 0.5 END AS floor, avg((nearest = zone)::INT) AS agree FROM w GROUP BY year, tier)
""" + _sql([
    ("contributions_add_up", E, "w", "(fault > 0.05::DOUBLE)", "fault"),
    ("residual_is_difference", E, "w", "(wrong > 0.016::DOUBLE)", "wrong"),
    ("residual_has_both", E, "w", "(CASE WHEN resid IS NOT NULL THEN obs IS NULL OR oof IS NULL END)", "NULL"),
    ("modelled_frame_has_no_observations", E, "w", "(CASE WHEN tier = 'modelled' THEN obs IS NOT NULL END)", "NULL"),
    ("observation_equals_cube", E, "w", "(CASE WHEN seen THEN off > 0.011::DOUBLE + 1e-9::DOUBLE END)", "off"),
    ("observation_gaps_equal", E, "w", "(CASE WHEN seen THEN (obs IS NULL) <> (lst IS NULL) END)", "NULL"),
    ("frame_has_contributions", E, "g", "(n = 0)", "NULL"),
    ("predictions_complete", W, "g", "(n < 0)", "NULL"),
    ("contributions_complete", W, "g", "(n < 0)", "NULL"),
    ("observed_frame_has_observations", W, "g", "(CASE WHEN tier = 'observed' THEN no / n <= 0.5 END)", "no / n"),
    ("prediction_follows_cube", E, "g", "(CASE WHEN tier = 'modelled' THEN cubed < 0.5 END)", "cubed"),
    ("prediction_follows_observation", E, "g", "(fit < floor)", "fit"),
    ("prediction_follows_weakly", W, "g", "(CASE WHEN fit >= floor THEN fit < 0.5 END)", "fit"),
    ("zone_is_nearest_centroid", E, "g", "(agree < 0.99)", "agree"),
]))
def q_check_attributions(spark, sf):
    """Additivity, residuals, and agreement of attributions with the cube and the zones; rows of several kinds are out of order."""
    f = _frames(spark).drop("level", "available").withColumn("base", F.lit(30.0)).withColumn("correction", F.lit(0.1))
    t = cube.cells(spark, sf).select("cell_id", "elev", *[scenario.ensemble([tree], 0.0, _features()).alias(n) for n, tree in zip("ab", TREES, strict=True)])
    t = t.join(cube.observations(spark, sf).select("cell_id", "year"), "cell_id").join(F.broadcast(f.select("year", "tier")), "year")  # one row a frame
    t = t.selectExpr("*", "30 + a + b + IF(cell_id % 83 = 0, 0.06D, 0D) AS pred", "IF(tier <> 'modelled' OR cell_id % 600 = 0, 29 + elev / 1000 + a, NULL) AS obs")
    lst = "IF(cell_id % 211 <> 0, IF(tier = 'modelled', 60 - pred, 29 + elev / 1000 + a - 0.1D) + IF(cell_id % 97 = 0, 0.02D, 0D), NULL) AS lst"
    d2 = ", ".join(f"struct((a - {x}D) * (a - {x}D) + (b - {y}D) * (b - {y}D) AS d, {k} AS k)" for k, (x, y) in enumerate(_CENTROIDS))
    t = t.selectExpr("*", "pred + (cell_id % 5 - 2) / 10D AS oof", "obs - pred - (cell_id % 5 - 2) / 10D + IF(cell_id % 301 = 0, 0.02D, 0D) AS resid", lst, f"array_min(array({d2})).k AS nearest")
    zones = t.selectExpr("cell_id", "year", "IF(cell_id % 40 = 0, (nearest + 1) % 4, nearest) AS zone")
    return _reported(checks.attributions(t.withColumn("phi", F.array("a", "b")), f, t.select("cell_id", "year", "lst"), zones, _CENTROIDS))


_YEARS = list(range(1992, 1999))


@query(f"""
WITH m AS (SELECT scope, year, value, CASE WHEN scope % 6 = 0 THEN value ELSE round(value, 2) END AS mean FROM annual WHERE scope <> 3 OR year <> 1995),
x AS (SELECT scope, year, mean, mean - 5 + CASE WHEN (scope + year) % 9 = 0 THEN 5.5::DOUBLE ELSE 0 END AS lo, mean + scope - 2 AS hi, scope * 2 - CASE WHEN scope = 1 THEN 3 ELSE 0 END AS n_cells, value - 130000 AS hot, year / 1998.0::DOUBLE + scope / 1000.0::DOUBLE AS coverage FROM m),
y AS (SELECT s.scope, n, y.year AS w FROM (SELECT DISTINCT scope, v.year FROM annual, (SELECT unnest(range(1992, 1999))::BIGINT AS year) v) s FULL JOIN (SELECT scope, year, 1 AS n FROM x) k ON k.scope = s.scope AND k.year = s.year LEFT JOIN (SELECT unnest(range(1992, 1999))::BIGINT AS year) y ON y.year = coalesce(s.year, k.year)),
q AS (SELECT scope, quantile_cont(value, [0.05, 0.25, 0.5, 0.75, 0.95]) AS q, avg(value) AS b, count(*) AS n FROM annual GROUP BY scope),
fan AS (SELECT q[1] + CASE WHEN scope % 8 = 0 THEN 10 * b ELSE 0 END AS p05, q[2] AS p25, q[3] AS p50, q[4] AS p75, q[5] AS p95, CASE WHEN scope = 9 THEN 'nan'::DOUBLE ELSE b END AS baseline, q[3] - b + CASE WHEN scope % 5 = 0 THEN 0.03::DOUBLE ELSE 0 END AS total, [0.5::DOUBLE, 0.3::DOUBLE, scope / 100.0::DOUBLE, 0.2::DOUBLE - scope / 100.0::DOUBLE + CASE WHEN scope % 7 = 3 THEN 0.1::DOUBLE ELSE 0 END] AS parts FROM q),
z AS (SELECT p05 > p25 + 1e-9::DOUBLE OR p25 > p50 + 1e-9::DOUBLE OR p50 > p75 + 1e-9::DOUBLE OR p75 > p95 + 1e-9::DOUBLE AS falls, CASE WHEN NOT isnan(baseline) THEN abs(p50 - baseline - total) END AS gap, isnan(baseline) AS odd, abs(list_sum(parts) - 1) AS sum_off, list_min(parts) AS small FROM fan),
h AS (SELECT scope, [min(year) FILTER (WHERE value > 140000), min(year) FILTER (WHERE value > 145000), min(year) FILTER (WHERE value > 150000)] AS t FROM annual GROUP BY scope),
k AS (SELECT t, list_filter(t, lambda v: v IS NOT NULL) AS got FROM h)
""" + _sql([
    ("interval_ordered", E, "x", "(lo > hi)", "lo - hi"),
    ("interval_holds_mean", E, "x", "(mean < lo - 0.011::DOUBLE OR mean > hi + 0.011::DOUBLE)", "greatest(lo - mean, mean - hi)"),
    ("mean_has_two_decimals", E, "x", "(abs(round(mean, 2) - mean) >= 1e-9::DOUBLE)", "NULL"),
    ("cell_count", E, "x", "(n_cells NOT BETWEEN 0 AND 40)", "n_cells"),
    ("hot_area", E, "x", "(hot < 0)", "hot"),
    ("coverage_share", E, "x", "(coverage NOT BETWEEN 0 AND 1)", "coverage"),
    ("scope_has_frame", E, "y", "(n IS NULL)", "NULL"),
    ("scope_frame_listed", E, "y", "(w IS NULL)", "NULL"),
    ("scope_frame_unique", E, "y", "(n > 1)", "n"),
    ("fan_ordered", E, "z", "(falls)", "NULL"),
    ("total_is_change", E, "z", "(gap > 0.02::DOUBLE + 1e-9::DOUBLE)", "gap"),
    ("baseline_finite", E, "z", "(odd)", "NULL"),
    ("budget_sums_to_one", E, "z", "(sum_off > 0.01::DOUBLE OR small < -1e-9::DOUBLE)", "sum_off"),
    ("threshold_year_listed", E, "k", "(len(list_filter(got, lambda v: v < 1992 OR v > 1998)) > 0)", "NULL"),
    ("threshold_years_rise", E, "k", "(list_sort(got) <> got)", "NULL"),
    ("threshold_years_have_no_gap", E, "k", "(len(list_filter(t[1:len(got)], lambda v: v IS NULL)) > 0)", "NULL"),
]))
def q_check_series(spark, sf):
    """Intervals, counts and frames of the series, order and budgets of the fans, and years in which thresholds are reached."""
    a = cube.annual(spark, sf)
    m = a.filter("scope <> 3 OR year <> 1995").withColumn("mean", F.when(F.col("scope") % 6 == 0, F.col("value")).otherwise(F.round("value", 2)))
    x = m.selectExpr("scope", "year", "mean", "mean - 5 + IF((scope + year) % 9 = 0, 5.5D, 0D) AS lo", "mean + scope - 2 AS hi", "scope * 2 - IF(scope = 1, 3, 0) AS n_cells", "value - 130000 AS hot", "year / 1998D + scope / 1000D AS coverage")
    q = a.groupBy("scope").agg(F.percentile("value", F.array(*[F.lit(p) for p in (0.05, 0.25, 0.5, 0.75, 0.95)])).alias("q"), F.avg("value").alias("b"))  # a value for each year
    fan = q.selectExpr("scope", "'one' AS scenario", "2050 AS year", "q[0] + IF(scope % 8 = 0, 10 * b, 0D) AS p05", "q[1] AS p25", "q[2] AS p50", "q[3] AS p75", "q[4] AS p95", "IF(scope = 9, double('NaN'), b) AS baseline", "q[2] - b + IF(scope % 5 = 0, 0.03D, 0D) AS total", "array(0.5D, 0.3D, scope / 100D, 0.2D - scope / 100D + IF(scope % 7 = 3, 0.1D, 0D)) AS parts")
    over = [F.min(F.when(F.col("value") > v, F.col("year"))) for v in (140000, 145000, 150000)]
    years = a.groupBy("scope").agg(F.array(*over).alias("first")).withColumn("scenario", F.lit("one"))
    return _reported(checks.series(x, _YEARS, 40) + checks.fans(fan) + checks.threshold_years(years, _YEARS))
