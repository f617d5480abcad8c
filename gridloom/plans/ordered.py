"""Windows, ranks, series and top-k."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import order, regress, windows
from ..operators.scratch import stored
from ..sources import cube
from .registry import query

R = S.fixed


@query("SELECT scope, year, round(value, 2) AS value, row_number() OVER (PARTITION BY year ORDER BY value DESC, scope) AS rank FROM annual")
def q_rank_bump(spark, sf):
    r = windows.rank_bump(cube.annual(spark, sf), "year", "value", "scope")
    return r.select("scope", "year", R(F.col("value"), 2).alias("value"), F.col("rank").cast("long").alias("rank"))


@query("SELECT scope, min(year) AS first_frame, max(year) AS last_frame, round(arg_max(value, year) - arg_min(value, year), 2) + 0.0 AS change FROM annual GROUP BY scope")
def q_first_last_change(spark, sf):
    return windows.first_last_change(cube.annual(spark, sf), "scope", "year", "value").withColumn("change", R(F.col("change"), 2))


@query("SELECT scope, year, round(value - avg(value) FILTER (WHERE year BETWEEN 1995 AND 1997) OVER (PARTITION BY scope), 2) + 0.0 AS anomaly FROM annual")
def q_reference_anomaly(spark, sf):
    return windows.reference_anomaly(cube.annual(spark, sf), "scope", "year", "value", 1995, 1997).select("scope", "year", R(F.col("anomaly"), 2).alias("anomaly"))


@query("""
WITH s AS (SELECT scope, year, CASE WHEN value >= 180000 THEN 'high' ELSE 'low' END AS state FROM annual),
f AS (SELECT *, CASE WHEN state = lag(state) OVER (PARTITION BY scope ORDER BY year) THEN 0 ELSE 1 END AS new FROM s),
g AS (SELECT *, sum(new) OVER (PARTITION BY scope ORDER BY year) AS run FROM f)
SELECT scope, run::BIGINT AS run, state, min(year) AS first_frame, max(year) AS last_frame, count(*) AS n FROM g GROUP BY ALL""")
def q_gaps_islands_tiers(spark, sf):
    return windows.runs(cube.annual(spark, sf), "scope", "year", F.when(F.col("value") >= 180000, "high").otherwise("low"))


@query("""SELECT scope, year, CAST(sum(CAST(value AS DECIMAL(18, 4))) OVER w AS DOUBLE) / count(*) OVER w AS smooth FROM annual
WINDOW w AS (PARTITION BY scope ORDER BY year ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""")
def q_smooth3(spark, sf):
    a = cube.annual(spark, sf).withColumn("value", F.col("value").cast("decimal(18,4)"))
    return windows.smooth3(a, "scope", "year", "value").select("scope", "year", "smooth")


@query("""
WITH a AS (SELECT scope, year, value - 180000 AS y FROM annual), l AS (SELECT *, lead(year) OVER w AS x2, lead(y) OVER w AS y2 FROM a WINDOW w AS (PARTITION BY scope ORDER BY year))
SELECT scope, round(year + (x2 - year) * (-y) / (y2 - y), 4) AS crossing, round(y2 - y, 2) AS jump FROM l WHERE y * y2 < 0""")
def q_zero_crossings(spark, sf):
    a = cube.annual(spark, sf).withColumn("y", F.col("value") - 180000)
    return windows.zero_crossings(a, "scope", "year", "y").select("scope", R(F.col("crossing")).alias("crossing"), R(F.col("jump"), 2).alias("jump"))


@query("""SELECT a.scope, round(quantile_cont((b.value - a.value) / (b.year - a.year), 0.5), 2) + 0.0 AS slope, count(*) AS pairs
FROM annual a JOIN annual b ON a.scope = b.scope AND a.year < b.year GROUP BY a.scope""")
def q_theil_sen(spark, sf):
    return windows.theil_sen(cube.annual(spark, sf), "scope", "year", "value").withColumn("slope", R(F.col("slope"), 2))


_KNOTS = "SELECT scope, year, value FROM annual WHERE year % 2 = 1"
_LOOKUP = """
WITH k AS (SELECT scope, year::DOUBLE AS x, value AS y FROM annual WHERE year % 2 = 1),
p AS (SELECT DISTINCT scope, year::DOUBLE + 0.5 AS x FROM annual WHERE year % 2 = 0 UNION SELECT DISTINCT scope, 1990.0 FROM annual UNION SELECT DISTINCT scope, 2010.0 FROM annual),
b AS (SELECT p.scope, p.x, (SELECT max(x) FROM k WHERE k.scope = p.scope AND k.x <= p.x) AS x1, (SELECT min(x) FROM k WHERE k.scope = p.scope AND k.x >= p.x) AS x2 FROM p)
SELECT b.scope, b.x, round(CASE WHEN x1 IS NULL THEN c.y WHEN x2 IS NULL THEN a.y WHEN x1 = x2 THEN a.y ELSE {inner} END, 2) AS y
FROM b LEFT JOIN k a ON a.scope = b.scope AND a.x = x1 LEFT JOIN k c ON c.scope = b.scope AND c.x = x2"""


def _looked_up(spark, sf, geometric):
    a = cube.annual(spark, sf)
    k = a.filter("year % 2 = 1").select("scope", F.col("year").cast("double").alias("x"), F.col("value").alias("y"))
    s = a.select("scope").distinct()
    p = a.filter("year % 2 = 0").select("scope", (F.col("year") + 0.5).alias("x")).union(s.select("scope", F.explode(F.array(F.lit(1990.0), F.lit(2010.0))).alias("x")))
    return windows.interpolate(k, p, "scope", "x", "y", geometric).withColumn("y", R(F.col("y"), 2))


@query(_LOOKUP.replace("{inner}", "pow(a.y, 1 - (b.x - x1) / (x2 - x1)) * pow(c.y, (b.x - x1) / (x2 - x1))"))
def q_geo_interp(spark, sf):
    return _looked_up(spark, sf, True)


@query(_LOOKUP.replace("{inner}", "a.y + (c.y - a.y) * (b.x - x1) / (x2 - x1)"))
def q_piecewise_lookup(spark, sf):
    return _looked_up(spark, sf, False)


@query("""SELECT cls, round(elev, 4) AS quantile FROM (SELECT cls, elev, row_number() OVER (PARTITION BY cls ORDER BY elev) - 1 AS r, floor(0.98 * (count(*) OVER (PARTITION BY cls) - 1)) AS k FROM cells) WHERE r = k""")
def q_nearest_rank_quantile(spark, sf):
    return windows.nearest_rank(cube.cells(spark, sf), "cls", "elev", 0.98).withColumn("quantile", R(F.col("quantile")))


@query("""
SELECT k, i, m, rank FROM (SELECT label AS k, i, round(avg(x), 5) + 0.0 AS m, row_number() OVER (PARTITION BY label ORDER BY abs(round(avg(x), 5)) DESC, i) AS rank
  FROM (SELECT label, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label, i) WHERE rank <= 8""", cube=False)
def q_topk_signature(spark, sf):
    """The eight strongest mean components of each label."""
    e = cube.table(spark, sf, "embeddings").select(F.col("label").alias("k"), F.posexplode("embedding").alias("i", "x"))
    m = e.groupBy("k", "i").agg(R(F.avg(F.col("x").cast("double")), 5).alias("m"))
    return windows.top_k(m, "k", [F.abs("m").desc(), F.col("i")], 8).select("k", "i", "m", F.col("rank").cast("long").alias("rank"))


@query("""
WITH g AS (SELECT year, lst, count(*) AS k FROM obs GROUP BY ALL), r AS (SELECT year, lst, k, coalesce(sum(k) OVER (PARTITION BY year ORDER BY lst ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(k) OVER (PARTITION BY year) AS n FROM g)
SELECT cell_id, year, round(100 * (below + k / 2) / r.n, 4) AS pct FROM obs JOIN r USING (year, lst)""")
def q_percent_rank(spark, sf):
    """Mid-rank percentile within each frame: ranks instead of a self-join."""
    o = stored(cube.observations(spark, sf).select("cell_id", "year", "lst"), "values")
    r = order.ranks(o, ["year"], "lst")
    return o.join(r, ["year", "lst"]).select("cell_id", "year", R(100 * (F.col("below") + F.col("equal") / 2) / F.col("n")).alias("pct"))


@query("SELECT scope, min(year) FILTER (WHERE value > 185000) AS first_year FROM annual GROUP BY scope")
def q_first_year_above(spark, sf):
    return cube.annual(spark, sf).groupBy("scope").agg(F.min(F.when(F.col("value") > 185000, F.col("year"))).alias("first_year"))


@query("SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE r % greatest(1, n // 50) = 0", cube=False)
def q_stride_sample(spark, sf):
    """Every k-th event of each type, k a fiftieth of the type's events; numbers come from ranges of (type, event)."""
    e = order.running(cube.table(spark, sf, "events").select("event_type", "event_id", "value"), ["event_type"], ["event_id"], F.lit(1), "r")
    e = stored(e, "numbered")
    n = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return e.join(n, "event_type").filter(F.expr("r % greatest(1, n div 50) = 0")).select("event_type", "event_id", "value")


@query("SELECT scope, year, value FROM (SELECT scope, year, round(value, 2) AS value, row_number() OVER (PARTITION BY year ORDER BY value DESC, scope) AS r FROM annual) WHERE r <= 3")
def q_hottest_scopes(spark, sf):
    return windows.top_k(cube.annual(spark, sf), "year", [F.col("value").desc(), F.col("scope")], 3).select("scope", "year", R(F.col("value"), 2).alias("value"))


@query("""SELECT max(n) AS best_n, arg_max(cls, (r2, cls)) AS best FROM (SELECT cls, count(*) AS n, round(regr_r2(lst, elev), 6) AS r2 FROM obs JOIN cells USING (cell_id) GROUP BY cls)""")
def q_best_model(spark, sf):
    d = cube.observations(spark, sf).join(cube.cells(spark, sf), "cell_id")
    g = d.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), R(F.regr_r2("lst", "elev"), 6).alias("r2"))
    return g.agg(F.max("n").alias("best_n"), F.max_by("cls", F.struct("r2", "cls")).alias("best"))


@query("""
WITH g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, session::BIGINT AS session, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY ALL""", cube=False)
def q_sessions(spark, sf):
    """Runs of a user's events without a gap of more than an hour."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = at - F.lag(at).over(w)
    e = cube.table(spark, sf, "events").withColumn("new", F.when(gap.isNull() | (gap > 3600 * 1000000), 1).otherwise(0))
    e = e.withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("""
WITH r AS (SELECT cls, elev, built, rank() OVER (PARTITION BY cls ORDER BY elev) + (count(*) OVER (PARTITION BY cls, elev) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY cls ORDER BY built) + (count(*) OVER (PARTITION BY cls, built) - 1) / 2.0 AS ry FROM cells)
SELECT cls, round(corr(rx, ry), 6) + 0.0 AS rho, count(*) AS n FROM r GROUP BY cls""")
def q_spearman_direction(spark, sf):
    return regress.spearman(cube.cells(spark, sf), "cls", "elev", "built").withColumn("rho", R(F.col("rho"), 6))
