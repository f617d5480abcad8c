"""Dependence curves of the tree model and their thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import curves, grid, scenario
from ..operators.scratch import stored
from ..sources import cube
from .models import BASE, TREES, _features
from .projections import _MIXED
from .registry import query

R = S.fixed
BINS, REPLICATES, SEED = 25, 20, 5

_U = f"({_MIXED.format(a=_MIXED.format(a=f'{SEED * 16}::BIGINT', b='block'), b='rep')} + 0.5) / 2147483647.0::DOUBLE"
_POISSON = ", ".join(f"{p!r}::DOUBLE" for p in curves.POISSON)

#: Effect of the model by sector: e(k, x, y, block, bin).
_EFFECTS = f"""
f AS (SELECT cell_id, district // 5 AS sector, row // 5 * 5 + col // 5 AS block, built, CASE WHEN cell_id % 7 <> 0 THEN built END AS a, CASE WHEN cell_id % 11 <> 0 THEN elev / 1000 END AS b, row / 80 AS c FROM cells),
t AS (SELECT *, 30.0 + CASE WHEN a IS NULL OR a < 0.5 THEN CASE WHEN b IS NULL OR b < 1.2 THEN -0.4 ELSE 0.1 END ELSE 0.7 END + CASE WHEN b < 1.5 THEN -0.2 WHEN c IS NULL OR c < 0.5 THEN 0.3 ELSE 0.9 END AS pred FROM f),
e AS (SELECT sector, built AS x, pred - avg(pred) OVER (PARTITION BY sector) AS y, block, floor(built * {BINS}) AS bin FROM t)"""


def _best(out: str, points: str, asked: str) -> str:
    """Common tables: the best hinge of each curve."""
    cov = lambda a, b: f"sum(w * {a} * {b}) / sum(w) - sum(w * {a}) / sum(w) * sum(w * {b}) / sum(w)"
    return f"""
{out}_s AS (SELECT k, h, {cov('c', 'c')} AS xx, {cov('greatest(0, c - h)', 'greatest(0, c - h)')} AS hh, {cov('c', 'greatest(0, c - h)')} AS xh, {cov('c', 'm')} AS xy, {cov('greatest(0, c - h)', 'm')} AS hy, {cov('m', 'm')} AS yy,
  sum(w) AS sw, count(*) FILTER (WHERE c <= h) AS nl, count(*) FILTER (WHERE c > h) AS nr, coalesce(sum(w) FILTER (WHERE c <= h), 0) AS wl, coalesce(sum(w) FILTER (WHERE c > h), 0) AS wr FROM {points} JOIN {asked} USING (k) GROUP BY k, h),
{out}_d AS (SELECT *, CASE WHEN xx * hh - xh * xh > 1e-10::DOUBLE * xx * hh THEN xx * hh - xh * xh END AS det FROM {out}_s),
{out}_b AS (SELECT *, coalesce((xy * hh - hy * xh) / det, xy / xx) AS slope, coalesce((hy * xx - xy * xh) / det, 0) AS bend, sw * (yy - xy * xy / xx) AS line FROM {out}_d),
{out}_e AS (SELECT *, greatest(0, sw * (yy - slope * xy - bend * hy)) AS sse FROM {out}_b),
{out} AS (SELECT DISTINCT ON (k) * FROM (SELECT *, min(sse) OVER (PARTITION BY k) AS least FROM {out}_e) WHERE sse <= least + 1e-9::DOUBLE * sw * yy ORDER BY k, h)"""


#: From curve(k, c, m, w) to th(k, zero_crossing, multiple, breakpoint, ...).
_THRESHOLDS = f"""
p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY c) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM curve WHERE w > 0),
x AS (SELECT k, c - m * (c1 - c) / (m1 - m) AS x, abs(m1 - m) AS jump FROM (SELECT *, lead(c) OVER u AS c1, lead(m) OVER u AS m1 FROM p WINDOW u AS (PARTITION BY k ORDER BY i)) WHERE (m < 0 AND m1 >= 0) OR (m > 0 AND m1 <= 0)),
xr AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY jump DESC, x DESC) AS r FROM x),
z AS (SELECT k, max(x) FILTER (WHERE r = 1) AS x1, max(jump) FILTER (WHERE r = 1) AS j1, max(jump) FILTER (WHERE r = 2) AS j2 FROM xr GROUP BY k),
inner_ AS (SELECT k, min(c) AS a, max(c) AS b FROM p WHERE n >= 5 AND i BETWEEN greatest(1, floor(0.1::DOUBLE * (n - 1))) AND least(n - 2, ceil(0.9::DOUBLE * (n - 1))) GROUP BY k HAVING min(c) < max(c)),
asked AS (SELECT k, c AS h FROM p JOIN inner_ USING (k) WHERE c BETWEEN a AND b UNION SELECT k, a + (b - a) * j / 120.0::DOUBLE FROM inner_, range(121) t(j)),
{_best('bp', 'p', 'asked')},
br AS (SELECT bp.* FROM bp JOIN inner_ USING (k) JOIN (SELECT k, max(abs(c)) AS far FROM p GROUP BY k) USING (k)
  WHERE line > 1e-12 AND sse <= 0.9::DOUBLE * line AND h > a + 1e-9 * greatest(1, far) AND h < b - 1e-9 * greatest(1, far) AND least(nl, nr) >= 5 AND least(wl, wr) >= 0.05::DOUBLE * sw),
v AS (SELECT *, avg(m) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v, c - lag(c) OVER (PARTITION BY k ORDER BY i) AS ga, lead(c) OVER (PARTITION BY k ORDER BY i) - c AS gz FROM p WHERE n >= 5),
s AS (SELECT *, abs(CASE WHEN ga IS NULL THEN (lead(v) OVER u - v) / gz WHEN gz IS NULL THEN (v - lag(v) OVER u) / ga ELSE (ga * ga * lead(v) OVER u + (gz * gz - ga * ga) * v - gz * gz * lag(v) OVER u) / (ga * gz * (ga + gz)) END) AS s FROM v WINDOW u AS (PARTITION BY k ORDER BY i)),
sm AS (SELECT *, max(s) OVER (PARTITION BY k) AS top, max(v) OVER (PARTITION BY k) - min(v) OVER (PARTITION BY k) AS span, last_value(v) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fin FROM s),
sf AS (SELECT *, min(CASE WHEN s >= top * (1 - 1e-9::DOUBLE) THEN i END) OVER (PARTITION BY k) AS steep, (s < 0.1::DOUBLE * top)::INT + coalesce(lead((s < 0.1::DOUBLE * top)::INT) OVER u, 0) + coalesce(lead((s < 0.1::DOUBLE * top)::INT, 2) OVER u, 0) AS run FROM sm WHERE top > 0 WINDOW u AS (PARTITION BY k ORDER BY i)),
so AS (SELECT *, min(CASE WHEN i > steep AND run = 3 AND abs(fin - v) <= 0.25::DOUBLE * span THEN i END) OVER (PARTITION BY k) AS onset FROM sf),
seg AS (SELECT k, i, onset, c, m, 1.0::DOUBLE AS w FROM so WHERE i BETWEEN greatest(steep, onset - 4) AND onset + 2),
knees AS (SELECT k, a + (b - a) * j / 80.0::DOUBLE AS h FROM (SELECT k, min(c) AS a, max(c) FILTER (WHERE i = onset) AS b FROM seg GROUP BY k), range(81) t(j)),
{_best('sat', 'seg', 'knees')},
th AS (SELECT k, CASE WHEN j2 IS NULL OR j1 >= 2 * j2 THEN x1 END AS zero_crossing, coalesce(j1 < 2 * j2, false) AS multiple, br.h AS breakpoint, br.slope AS slope_before, br.slope + br.bend AS slope_after, sat.h AS saturation,
  g.slope AS slope, g.effect_range, g.bins FROM (SELECT k, CASE WHEN count(*) >= 3 THEN (sum(w * c * m) / sum(w) - sum(w * c) / sum(w) * sum(w * m) / sum(w)) / (sum(w * c * c) / sum(w) - sum(w * c) / sum(w) * sum(w * c) / sum(w)) END AS slope, max(m) - min(m) AS effect_range, count(*) AS bins FROM p GROUP BY k) g
  LEFT JOIN z USING (k) LEFT JOIN br USING (k) LEFT JOIN sat USING (k))"""


def _effects(spark, sf):
    """sector, x, y, block: the model's effect on a cell and the share it may depend on."""
    c = cube.cells(spark, sf)
    e = c.select(F.floor(F.col("district") / 5).alias("sector"), grid.block_id(5, cube.WIDTH).alias("block"), F.col("built").alias("x"), scenario.ensemble(TREES, BASE, _features()).alias("y"))
    m = e.groupBy("sector").agg(F.avg("y").alias("m"))
    return e.join(F.broadcast(m), "sector").withColumn("y", F.col("y") - F.col("m")).drop("m")  # five sectors


def _bin():
    return F.floor(F.col("x") * BINS)


@query(f"""
WITH {_EFFECTS},
curve AS (SELECT sector AS k, avg(x) AS c, avg(y) AS m, count(*)::DOUBLE AS w FROM e GROUP BY sector, bin),{_THRESHOLDS}
SELECT k AS sector, round(zero_crossing, 6) AS zero_crossing, multiple, round(breakpoint, 6) AS breakpoint, round(slope_before, 3) + 0.0 AS slope_before, round(slope_after, 3) + 0.0 AS slope_after,
  round(saturation, 6) AS saturation, round(slope, 4) + 0.0 AS slope, round(effect_range, 4) AS effect_range, bins FROM th""")
def q_curve_thresholds(spark, sf):
    """Zero crossing, breakpoint and saturation of each sector's dependence curve."""
    t = curves.thresholds(curves.binned(_effects(spark, sf), ["sector"], _bin(), F.col("x"), F.col("y")), ["sector"])
    digits = {"slope_before": 3, "slope_after": 3, "zero_crossing": 6, "breakpoint": 6, "saturation": 6}
    return t.select("sector", *[R(F.col(c), digits.get(c, 4)).alias(c) for c in ("zero_crossing", "breakpoint", "slope_before", "slope_after", "saturation", "slope", "effect_range")], "multiple", "bins")


_SUPPORT = ", ".join(
    f"round(CASE WHEN pt.{n} IS NOT NULL AND c_{n} >= 2 AND c_{n} / n >= 0.5 THEN pt.{n} + q_{n}[1] - q_{n}[2] END, 9) AS {n}_lo, round(CASE WHEN pt.{n} IS NOT NULL AND c_{n} >= 2 AND c_{n} / n >= 0.5 THEN pt.{n} + q_{n}[3] - q_{n}[2] END, 9) AS {n}_hi,"
    f" CASE WHEN pt.{n} IS NOT NULL THEN round(c_{n} / n, 9) END AS {n}_support"
    for n in ("zero_crossing", "breakpoint", "saturation")
)


@query(f"""
WITH {_EFFECTS},
bs AS (SELECT sector, block, bin, sum(x) AS sx, sum(y) AS sy, count(*) AS n FROM e GROUP BY ALL),
rw AS (SELECT *, len(list_filter([{_POISSON}], lambda p: p <= {_U})) AS pw FROM bs, (SELECT unnest(range(1, {REPLICATES + 1}))::BIGINT AS rep)),
curve AS (SELECT sector * 1000 AS k, avg(x) AS c, avg(y) AS m, count(*)::DOUBLE AS w FROM e GROUP BY sector, bin
  UNION ALL SELECT sector * 1000 + rep, sum(pw * sx) / sum(pw * n), sum(pw * sy) / sum(pw * n), sum(pw * n)::DOUBLE FROM rw WHERE pw > 0 GROUP BY sector, rep, bin),{_THRESHOLDS},
pt AS (SELECT k // 1000 AS sector, * FROM th WHERE k % 1000 = 0),
tol AS (SELECT sector, greatest({1 / BINS!r}::DOUBLE, 0.1::DOUBLE * (quantile_cont(x, 0.95) - quantile_cont(x, 0.05))) AS tol FROM e GROUP BY sector),
rp AS (SELECT pt.sector, CASE WHEN pt.zero_crossing IS NULL OR abs(th.zero_crossing - pt.zero_crossing) <= tol THEN th.zero_crossing END AS zero_crossing, th.breakpoint, th.saturation FROM th JOIN pt ON th.k // 1000 = pt.sector JOIN tol ON tol.sector = pt.sector WHERE th.k % 1000 > 0),
q AS (SELECT sector, count(*) AS n, {', '.join(f'count({n}) AS c_{n}, quantile_cont({n}, [0.025, 0.5, 0.975]) AS q_{n}' for n in ('zero_crossing', 'breakpoint', 'saturation'))} FROM rp GROUP BY sector)
SELECT pt.sector, {_SUPPORT} FROM pt JOIN q USING (sector)""")
def q_threshold_support(spark, sf):
    """Intervals and support of the thresholds from replicates of whole blocks."""
    e = stored(_effects(spark, sf), "effects")
    x, y = F.col("x"), F.col("y")
    point = curves.thresholds(curves.binned(e, ["sector"], _bin(), x, y), ["sector"])
    reps = curves.thresholds(curves.replicated(e, ["sector"], F.col("block"), _bin(), x, y, REPLICATES, SEED), ["sector", "rep"])
    tolerance = curves.crossing_tolerance(e, ["sector"], x, [i / BINS for i in range(BINS + 1)])
    s = curves.supported(point, reps, ["sector"], tolerance)
    return s.select("sector", *[R(F.col(f"{n}_{k}"), 9).alias(f"{n}_{k}") for n in ("zero_crossing", "breakpoint", "saturation") for k in ("lo", "hi", "support")])
