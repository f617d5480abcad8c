"""Levels of frames, observed and modelled."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import levels
from ..sources import cube
from .registry import query

R = S.fixed
_T95 = ", ".join(f"{t!r}::DOUBLE" for t in levels.T95)
_TIER = "CASE WHEN frame IN (1992, 2010) THEN 'modelled' WHEN frame = 1998 THEN 'reconstructed' ELSE 'observed' END"


@query(f"""
WITH a AS (SELECT CAST(c_nationkey AS BIGINT) AS scope, CAST(year(o_orderdate) AS BIGINT) AS year, count(*)::DOUBLE AS x, avg(o_totalprice) + 9000.0::DOUBLE * (year(o_orderdate) - 1995) * (c_nationkey % 2) AS y FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, year(o_orderdate)),
l AS (SELECT scope, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(year) AS mt, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy, regr_syy(y, x) AS syy, regr_sxx(y, year) AS stt FROM a GROUP BY scope HAVING count(*) >= 5),
b AS (SELECT *, sxy / sxx AS b, (syy - sxy * sxy / sxx) / (n - 2) AS s2 FROM l),
r AS (SELECT scope, year, y - my - b * (x - mx) AS e FROM a JOIN b USING (scope) WHERE year <= 1997),
d AS (SELECT scope, regr_slope(e, year) AS slope, sqrt((regr_syy(e, year) - regr_slope(e, year) * regr_sxy(e, year)) / ((count(*) - 2) * regr_sxx(e, year))) AS se, count(*) AS k, max(year) - min(year) AS span FROM r GROUP BY scope),
g AS (SELECT b.*, CASE WHEN k >= 5 AND span >= 5 AND abs(slope) > 2 * se THEN slope ELSE 0 END AS drift FROM b JOIN d USING (scope)),
f AS (SELECT scope, frame, frame - 1 AS first, frame + 1 AS last, {_TIER} AS tier, frame::DOUBLE AS t FROM (SELECT DISTINCT scope FROM a), (SELECT unnest([1992, 1994, 1996, 1997, 1998, 2010])::BIGINT AS frame)),
o AS (SELECT f.*, CASE WHEN tier <> 'modelled' THEN a.y + 50 * (f.scope % 3) END AS own FROM f LEFT JOIN a ON a.scope = f.scope AND a.year = f.frame),
w AS (SELECT o.scope, frame, avg(x) AS wx, count(*) AS years FROM o JOIN a ON a.scope = o.scope AND a.year BETWEEN first AND last GROUP BY ALL),
j AS (SELECT o.*, wx, years, n, mx, my, mt, sxx, stt, s2, drift, my + b * (wx - mx) AS fit FROM o LEFT JOIN w USING (scope, frame) LEFT JOIN g USING (scope)),
q AS (SELECT scope, avg(own) AS mean_own, avg(own - fit) AS off, avg(t) AS t0, count(*) AS m, var_samp(own - fit - drift * t) AS var FROM j WHERE tier = 'observed' GROUP BY scope),
z AS (SELECT *, drift * (t - t0) AS moved, fit + off + drift * (t - t0) AS predicted, list_extract([{_T95}], n - 2) * sqrt(s2 / years + s2 * (1 / n + (wx - mx) ** 2 / sxx) + var * (1 + 1 / m) + (t - mt) ** 2 * s2 / stt) AS reach FROM j JOIN q USING (scope))
SELECT scope, frame, tier, round(CASE WHEN tier <> 'modelled' THEN own ELSE coalesce(predicted, mean_own) END, 3) AS level, round(CASE WHEN tier <> 'modelled' THEN 0.5 WHEN predicted IS NOT NULL THEN reach ELSE 1.5 END, 3) AS half_width, coalesce(years, 0) AS years,
  round(CASE WHEN predicted IS NOT NULL THEN moved END, 3) + 0.0 AS drift, round(CASE WHEN tier <> 'modelled' THEN own - predicted END, 3) + 0.0 AS error, CASE WHEN tier <> 'modelled' THEN 'observed' WHEN predicted IS NOT NULL THEN 'regression' ELSE 'mean of observed' END AS method FROM z""", cube=False)
def q_modelled_levels(spark, sf):
    """Levels of all frames: observed ones with their error under the regression, others by the line, the mask offset and drift."""
    o, c = cube.table(spark, sf, "orders"), cube.table(spark, sf, "customer")
    year = F.year("o_orderdate").cast("long")
    a = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy(F.col("c_nationkey").cast("long").alias("scope"), year.alias("year")).agg(F.count(F.lit(1)).cast("double").alias("x"), F.avg("o_totalprice").alias("y"))
    a = a.withColumn("y", F.col("y") + 9000.0 * (F.col("year") - 1995) * (F.col("scope") % 2)).withColumn("primary", F.col("year") <= 1997)
    f = a.select("scope").distinct().withColumn("frame", F.explode(F.array(*[F.lit(y).cast("long") for y in (1992, 1994, 1996, 1997, 1998, 2010)])))
    f = f.selectExpr("scope", "frame", "frame - 1 AS first", "frame + 1 AS last", f"{_TIER} AS tier").join(a.select("scope", F.col("year").alias("frame"), "y"), ["scope", "frame"], "left")
    f = f.withColumn("level", F.when(F.col("tier") != "modelled", F.col("y") + 50 * (F.col("scope") % 3))).withColumn("half_width", F.lit(0.5))
    m = levels.modelled_levels(a, f, "scope", 5)
    return m.select("scope", "frame", "tier", *[R(F.col(n), 3).alias(n) for n in ("level", "half_width", "drift", "error")], "years", "method")
