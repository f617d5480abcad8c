"""Frame products, levels, what-if, lookups and serving reads."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import grid, order
from ..operators.scratch import new_path
from ..sources import cube
from .registry import query

R = S.fixed


def _joined(spark, sf):
    return cube.observations(spark, sf).join(cube.cells(spark, sf), "cell_id")


# Fields and display variables -----------------------------------------------------


@query("""
WITH l AS (SELECT year, avg(lst) AS level, 2 * stddev_samp(lst) / sqrt(count(*)) AS h FROM obs GROUP BY year),
a AS (SELECT cell_id, year, lst, level, h, built, len(list_filter([0.25, 0.5, 0.75], lambda e: e <= built)) AS k FROM obs JOIN cells USING (cell_id) JOIN l USING (year)),
q AS (SELECT k, quantile_cont(abs(lst - level), 0.9) AS q FROM a GROUP BY k)
SELECT cell_id, year, round(level + 0.5 * (lst - level), 3) AS p50, round(sqrt(q * q + h * h), 3) AS half, built > 0.9 AS outside FROM a JOIN q USING (k)""")
def q_frame_fields(spark, sf):
    """Modelled field: level plus shrunk anomaly, its half-width from error quantile by class and level, and the applicability flag."""
    j = _joined(spark, sf)
    level = j.groupBy("year").agg(F.avg("lst").alias("level"), (2 * F.stddev_samp("lst") / F.sqrt(F.count(F.lit(1)))).alias("h"))
    a = j.join(level, "year").withColumn("k", F.size(F.filter(F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75)]), lambda e: e <= F.col("built"))))
    q = a.groupBy("k").agg(F.percentile(F.abs(F.col("lst") - F.col("level")), F.lit(0.9)).alias("q"))
    half = F.sqrt(F.col("q") * F.col("q") + F.col("h") * F.col("h"))
    return a.join(q, "k").select("cell_id", "year", F.round(F.col("level") + 0.5 * (F.col("lst") - F.col("level")), 3).alias("p50"), F.round(half, 3).alias("half"), (F.col("built") > 0.9).alias("outside"))


@query("""SELECT event_type, round((10.75 - avg(hour(ts) + minute(ts) / 60.0)) * 0.5, 4) + 0.0 AS correction, count(*) AS n FROM events GROUP BY event_type""", cube=False)
def q_overpass_correction(spark, sf):
    """(10.75 - mean overpass hour) times a heating rate, for each frame."""
    h = F.hour("ts") + F.minute("ts") / 60.0
    return cube.table(spark, sf, "events").groupBy("event_type").agg(R((10.75 - F.avg(h)) * 0.5).alias("correction"), F.count(F.lit(1)).alias("n"))


@query("""
WITH r AS (SELECT year, avg(lst) FILTER (WHERE built <= 0.2) AS rural FROM obs JOIN cells USING (cell_id) GROUP BY year),
f AS (SELECT cell_id, lst AS ref FROM obs WHERE year = 1996)
SELECT o.cell_id, o.year, round(o.lst - r.rural, 3) + 0.0 AS suhi, round(o.lst - f.ref, 3) + 0.0 AS delta FROM obs o JOIN r USING (year) LEFT JOIN f USING (cell_id)""")
def q_display_variables(spark, sf):
    """Value less the rural mean of its frame, and less its own value in the reference frame."""
    j = _joined(spark, sf)
    rural = j.groupBy("year").agg(F.avg(F.when(F.col("built") <= 0.2, F.col("lst"))).alias("rural"))
    o = cube.observations(spark, sf)
    ref = o.filter("year = 1996").select("cell_id", F.col("lst").alias("ref"))
    return o.join(rural, "year").join(ref, "cell_id", "left").select("cell_id", "year", R(F.col("lst") - F.col("rural"), 3).alias("suhi"), R(F.col("lst") - F.col("ref"), 3).alias("delta"))


@query("SELECT cell_id, year, CASE WHEN n IS NULL THEN NULL WHEN 6.0 / n <= 1 THEN 0 WHEN 6.0 / n <= 2 THEN 1 WHEN 6.0 / n <= 4 THEN 2 ELSE 3 END AS code FROM obs")
def q_vsup_codes(spark, sf):
    """Uncertainty class of a half-width (here 3 over the number of passes) at 0.5, 1 and 2."""
    half = 3.0 / F.col("n")
    return cube.observations(spark, sf).select("cell_id", "year", F.when(half <= 0.5, 0).when(half <= 1, 1).when(half <= 2, 2).otherwise(3).alias("code"))


@query("""
WITH t AS (SELECT o.*, cls, elev FROM obs o JOIN cells USING (cell_id)), c AS (SELECT cls, regr_slope(lst, elev) AS b, regr_intercept(lst, elev) AS a FROM t WHERE cell_id % 2 = 0 GROUP BY cls HAVING count(*) >= 30),
p AS (SELECT regr_slope(lst, elev) AS b, regr_intercept(lst, elev) AS a FROM t WHERE cell_id % 2 = 0),
m AS (SELECT t.*, coalesce(c.a, p.a) + coalesce(c.b, p.b) * elev AS fit FROM t LEFT JOIN c USING (cls), p), s AS (SELECT cell_id, avg(lst - fit) * count(*) / (count(*) + 3.0) AS shrunk FROM m GROUP BY cell_id)
SELECT cell_id, year, round(fit + shrunk, 3) AS calibrated FROM m JOIN s USING (cell_id)""")
def q_apply_calibration(spark, sf):
    """Class line (the pooled one for classes without) plus the cell's shrunk residual."""
    t = _joined(spark, sf)
    fit = t.filter("cell_id % 2 = 0")
    line = lambda d: d.agg(F.regr_slope("lst", "elev").alias("b"), F.regr_intercept("lst", "elev").alias("a"), F.count(F.lit(1)).alias("m"))
    c, p = line(fit.groupBy("cls")).filter("m >= 30").drop("m"), line(fit.groupBy()).select(F.struct("a", "b"))
    m = t.join(c, "cls", "left").withColumn("p", p.scalar())
    m = m.withColumn("fit", F.coalesce("a", "p.a") + F.coalesce("b", "p.b") * F.col("elev"))
    n = F.count(F.lit(1))
    s = m.groupBy("cell_id").agg((F.avg(F.col("lst") - F.col("fit")) * n / (n + 3.0)).alias("shrunk"))
    return m.join(s, "cell_id").select("cell_id", "year", F.round(F.col("fit") + F.col("shrunk"), 3).alias("calibrated"))


@query("WITH m AS (SELECT year, avg(lst) AS m FROM obs WHERE year <> 1998 GROUP BY year) SELECT cell_id, year, round(built - 0.5 + coalesce(m, 0), 3) + 0.0 AS celsius FROM obs JOIN cells USING (cell_id) LEFT JOIN m USING (year)")
def q_prediction_to_celsius(spark, sf):
    """Anomaly prediction plus the frame mean; a frame without a mean passes through."""
    j = _joined(spark, sf)
    m = j.filter("year <> 1998").groupBy("year").agg(F.avg("lst").alias("m"))
    return j.join(m, "year", "left").select("cell_id", "year", R(F.col("built") - 0.5 + F.coalesce("m", F.lit(0.0)), 3).alias("celsius"))


# Filters ---------------------------------------------------------------------------


@query("SELECT cell_id, district FROM cells WHERE district IN (2, 7, 19)")
def q_select_region(spark, sf):
    return cube.cells(spark, sf).filter(F.col("district").isin(2, 7, 19)).select("cell_id", "district")


@query("SELECT cell_id, elev FROM cells WHERE elev BETWEEN 910 AND 1400")
def q_brush_mask(spark, sf):
    return cube.cells(spark, sf).filter(F.col("elev").between(910, 1400)).select("cell_id", "elev")


@query("""
WITH a AS (SELECT scope, count(*) AS n, regr_slope(value, year) AS b, regr_sxx(value, year) AS sxx, regr_syy(value, year) - regr_slope(value, year) * regr_sxy(value, year) AS sse FROM annual GROUP BY scope HAVING count(*) > 2),
c AS (SELECT scope, b, 2.57 * sqrt(greatest(sse, 0) / (n - 2) / sxx) AS h FROM a) SELECT scope, round(b, 5) + 0.0 AS slope, b - h > 0 OR b + h < 0 AS claim FROM c""")
def q_ci_excludes_zero(spark, sf):
    """A trend may be claimed where its interval leaves out zero."""
    sse = F.regr_syy("value", "year") - F.regr_slope("value", "year") * F.regr_sxy("value", "year")
    a = cube.annual(spark, sf).groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("value", "year").alias("b"), F.regr_sxx("value", "year").alias("sxx"), sse.alias("sse")).filter("n > 2")
    h = 2.57 * F.sqrt(F.greatest("sse", F.lit(0.0)) / (F.col("n") - 2) / F.col("sxx"))
    return a.select("scope", R(F.col("b"), 5).alias("slope"), ((F.col("b") - h > 0) | (F.col("b") + h < 0)).alias("claim"))


@query("SELECT cell_id, year FROM obs WHERE year <= 1999 AND CASE WHEN cell_id % 4 = 0 THEN year IN (1995, 1997, 1999) ELSE n >= 2 END")
def q_change_frames(spark, sf):
    """Frames admissible for change: those of the entity's own list where it has one, else by evidence; none after now."""
    listed = F.col("cell_id") % 4 == 0
    return cube.observations(spark, sf).filter("year <= 1999").filter(F.when(listed, F.col("year").isin(1995, 1997, 1999)).otherwise(F.col("n") >= 2)).select("cell_id", "year")


# Lookups and joins -----------------------------------------------------------------


@query("""
WITH q AS (SELECT event_id, (user_id * 7) % 1000 AS cell_id FROM events) SELECT event_id, q.cell_id, c.row, c.col, c.cell_id IS NOT NULL AS found FROM q LEFT JOIN cells c ON c.cell_id = q.cell_id""")
def q_cell_lookup(spark, sf):
    q = cube.table(spark, sf, "events").select("event_id", (F.col("user_id") * 7 % 1000).alias("cell_id"))
    c = cube.cells(spark, sf).select("cell_id", "row", "col", F.lit(True).alias("has"))
    return q.join(c, "cell_id", "left").select("event_id", "cell_id", "row", "col", F.coalesce("has", F.lit(False)).alias("found"))


@query("""
WITH p AS (SELECT event_id, (event_id * 37 % 300) / 10.0::DOUBLE AS y, (event_id * 53 % 240) / 10.0::DOUBLE AS x FROM events),
m AS (SELECT event_id, cell_id, (y - row) ** 2 + (x - col) ** 2 AS d2 FROM p JOIN cells ON abs(row - floor(y)) <= 2 AND abs(col - floor(x)) <= 2)
SELECT event_id, arg_min(cell_id, (round(d2, 6), cell_id)) AS nearest FROM m GROUP BY event_id""")
def q_cell_locator(spark, sf):
    """Nearest cell of a point, from the cells of the bins around it: a bin's cells are one array, so a point stays one row."""
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3)])
    c = cube.cells(spark, sf).select("cell_id", "row", "col").withColumn("k", F.explode(around))
    bins = c.groupBy((F.col("row") + F.col("k.i")).alias("br"), (F.col("col") + F.col("k.j")).alias("bc")).agg(F.collect_list(F.struct("row", "col", "cell_id")).alias("near"))
    e = F.col("event_id")
    p = cube.table(spark, sf, "events").select("event_id").distinct().select("event_id", (e * 37 % 300 / 10.0).alias("y"), (e * 53 % 240 / 10.0).alias("x"))
    p = p.withColumn("br", F.floor("y")).withColumn("bc", F.floor("x"))
    d2 = lambda c: F.round(F.pow(F.col("y") - c["row"], 2) + F.pow(F.col("x") - c["col"], 2), 6)
    least = F.array_min(F.transform("near", lambda c: F.struct(d2(c).alias("d2"), c["cell_id"].alias("cell_id"))))
    return p.join(bins.hint("merge"), ["br", "bc"]).select("event_id", least["cell_id"].alias("nearest"))


@query("""
WITH m AS (SELECT cell_id, year, avg(v) FILTER (WHERE flag = 'A') AS a, avg(v) FILTER (WHERE flag = 'N') AS b FROM pixels GROUP BY ALL)
SELECT year, count(*) AS overlap, round(avg(a - b), 3) + 0.0 AS difference, round(sqrt(avg((a - b) ** 2)), 3) AS rmse FROM m WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY year""")
def q_day_level_check(spark, sf):
    """Two sensors over their common cells and frames."""
    m = cube.pixels(spark, sf).groupBy("cell_id", "year").agg(F.avg(F.when(F.col("flag") == "A", F.col("v"))).alias("a"), F.avg(F.when(F.col("flag") == "N", F.col("v"))).alias("b"))
    d = F.col("a") - F.col("b")
    return m.filter("a is not null and b is not null").groupBy("year").agg(F.count(F.lit(1)).alias("overlap"), R(F.avg(d), 3).alias("difference"), R(F.sqrt(F.avg(d * d)), 3).alias("rmse"))


@query("SELECT min(elev) AS low, max(elev) AS high, count(*) AS n FROM cells WHERE row BETWEEN 2 AND 6 AND col BETWEEN 5 AND 15")
def q_raster_range(spark, sf):
    c = cube.cells(spark, sf).filter(F.col("row").between(2, 6) & F.col("col").between(5, 15))
    return c.agg(F.min("elev").alias("low"), F.max("elev").alias("high"), F.count(F.lit(1)).alias("n"))


@query("""
WITH w AS (SELECT * FROM (VALUES (1996, 1995, 1997), (1998, 1997, 1999), (2000, 1999, 2001)) t(frame, y0, y1))
SELECT frame, scope, count(*) AS years, round(avg(value), 2) AS mean FROM w JOIN annual ON year BETWEEN y0 AND y1 GROUP BY ALL""")
def q_frame_windows(spark, sf):
    """Overlapping frame windows over annual rows: each row is sent to the few windows that hold it."""
    windows = F.array(*[F.struct(F.lit(f).alias("frame"), F.lit(a).alias("y0"), F.lit(b).alias("y1")) for f, a, b in ((1996, 1995, 1997), (1998, 1997, 1999), (2000, 1999, 2001))])
    a = cube.annual(spark, sf).withColumn("w", F.explode(F.filter(windows, lambda w: F.col("year").between(w["y0"], w["y1"]))))
    return a.groupBy(F.col("w.frame").alias("frame"), "scope").agg(F.count(F.lit(1)).alias("years"), R(F.avg("value"), 2).alias("mean"))


# Scalar families -------------------------------------------------------------------


@query("""SELECT event_id, month(ts) BETWEEN 3 AND 6 AS season, CAST(floor(((hour(ts) * 60 + minute(ts)) + 330) / 60) AS BIGINT) % 24 AS ist_hour, strftime(ts, '%m-%d') AS day FROM events""", cube=False)
def q_season_hours(spark, sf):
    """Season of the year, hour at UTC+5:30, day as MM-DD."""
    minutes = F.hour("ts") * 60 + F.minute("ts") + 330
    return cube.table(spark, sf, "events").select("event_id", F.month("ts").between(3, 6).alias("season"), (F.floor(minutes / 60) % 24).cast("long").alias("ist_hour"), F.date_format("ts", "MM-dd").alias("day"))


@query("SELECT p_partkey, coalesce(map {'SMALL': 1, 'MEDIUM': 2, 'LARGE': 3}[string_split(p_type, ' ')[1]], 0) AS code FROM part", cube=False)
def q_map_remap(spark, sf):
    """Class remap through a map; unknown classes become 0."""
    codes = F.create_map(*[F.lit(x) for pair in (("SMALL", 1), ("MEDIUM", 2), ("LARGE", 3)) for x in pair])
    return cube.table(spark, sf, "part").select("p_partkey", F.coalesce(F.try_element_at(codes, F.split("p_type", " ")[0]), F.lit(0)).alias("code"))


# Neighbourhoods --------------------------------------------------------------------


@query("""
SELECT a.cell_id, round(avg(b.built) FILTER (WHERE abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1), 8) AS built_3, round(avg(b.elev) FILTER (WHERE abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1), 4) AS elev_3,
 round(avg(b.built), 8) AS built_15, round(avg(b.elev), 4) AS elev_15 FROM cells a JOIN cells b ON abs(a.row - b.row) <= 7 AND abs(a.col - b.col) <= 7 GROUP BY a.cell_id""")
def q_focal_columns(spark, sf):
    """Focal means of several bases at two windows."""
    c = cube.cells(spark, sf).drop("district")
    d = grid.dense(c).join(c, ["row", "col"], "left")
    for size in (3, 15):
        for base in ("built", "elev"):
            d = grid.box_mean(d, base, size, name=f"{base}_{size}")
    return d.filter("cell_id is not null").select("cell_id", *[R(F.col(f"{b}_{s}"), 8 if b == "built" else 4).alias(f"{b}_{s}") for s in (3, 15) for b in ("built", "elev")])


@query("""
WITH s(ax, ay, bx, cy) AS (VALUES (2.0::DOUBLE, 3.0::DOUBLE, 12.0::DOUBLE, 9.0::DOUBLE), (12.0, 9.0, 20.0, 4.0), (20.0, 4.0, 24.0, 30.0)),
t AS (SELECT cell_id, row, col, ax, ay, bx, cy, greatest(0, least(1, ((col - ax) * (bx - ax) + (row - ay) * (cy - ay)) / ((bx - ax) ** 2 + (cy - ay) ** 2))) AS u FROM cells, s)
SELECT cell_id, round(min(sqrt((col - ax - u * (bx - ax)) ** 2 + (row - ay - u * (cy - ay)) ** 2)), 6) AS distance FROM t GROUP BY cell_id""")
def q_polyline_distance(spark, sf):
    """Distance to a line of a few segments: an array expression."""
    line = [(2.0, 3.0), (12.0, 9.0), (20.0, 4.0), (24.0, 30.0)]
    x, y = F.col("col"), F.col("row")

    def to_segment(a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - a[0]) * dx + (y - a[1]) * dy) / (dx**2 + dy**2)))
        return F.sqrt(F.pow(x - a[0] - u * dx, 2) + F.pow(y - a[1] - u * dy, 2))

    return cube.cells(spark, sf).select("cell_id", R(F.least(*[to_segment(a, b) for a, b in zip(line, line[1:], strict=False)]), 6).alias("distance"))


# Calibration, levels, validation ---------------------------------------------------


@query("""
SELECT event_type, count(*) AS scenes, count(*) FILTER (WHERE user_id % 10 <= 6) AS clear, round(avg(hour(ts) + minute(ts) / 60.0) FILTER (WHERE user_id % 10 <= 6), 4) AS overpass FROM events GROUP BY event_type""", cube=False)
def q_scene_summary(spark, sf):
    """Scenes, clear scenes and their mean overpass hour."""
    clear = F.col("user_id") % 10 <= 6
    return cube.table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("scenes"), F.count_if(clear).alias("clear"), R(F.avg(F.when(clear, F.hour("ts") + F.minute("ts") / 60.0))).alias("overpass"))


@query("""
WITH p AS (SELECT scope, avg(value) FILTER (WHERE year = 1996) AS a, avg(value) FILTER (WHERE year = 1998) AS b FROM annual GROUP BY scope)
SELECT scope, CASE WHEN (b - a) / 2 BETWEEN -40000 AND 40000 THEN round((b - a) / 2, 2) + 0.0 END AS rate FROM p""")
def q_heating_rate(spark, sf):
    """Half the difference of two times, null where it is not plausible."""
    at = lambda y: F.avg(F.when(F.col("year") == y, F.col("value")))
    p = cube.annual(spark, sf).groupBy("scope").agg(((at(1998) - at(1996)) / 2).alias("r"))
    return p.select("scope", F.when(F.col("r").between(-40000, 40000), R(F.col("r"), 2)).alias("rate"))


@query("""
WITH f AS (SELECT cell_id FROM obs WHERE year IN (1996, 1997) GROUP BY cell_id HAVING count(*) = 2),
g AS (SELECT year, avg(lst) AS raw, avg(lst) FILTER (WHERE f.cell_id IS NOT NULL) AS fixed, count(*) / (SELECT count(*)::DOUBLE FROM cells) AS coverage FROM obs LEFT JOIN f USING (cell_id) GROUP BY year)
SELECT year, round(raw + CASE WHEN coverage < 0.999 THEN fixed - raw ELSE 0 END, 3) AS level, round(sqrt(0.09 + (0.5 * CASE WHEN coverage < 0.999 THEN fixed - raw ELSE 0 END) ** 2), 4) AS half FROM g""")
def q_levels(spark, sf):
    """Frame level with its composition correction, made only where coverage is incomplete, and its half-width."""
    o = cube.observations(spark, sf)
    both = o.filter("year in (1996, 1997)").groupBy("cell_id").count().filter("count = 2").select("cell_id", F.lit(1).alias("both"))
    total = cube.cells(spark, sf).select(F.count(F.lit(1)).cast("double"))
    g = o.join(both, "cell_id", "left").groupBy("year").agg(F.avg("lst").alias("raw"), F.avg(F.when(F.col("both") == 1, F.col("lst"))).alias("fixed"), F.count(F.lit(1)).alias("n"))
    g = g.withColumn("comp", F.when(F.col("n") / total.scalar() < 0.999, F.col("fixed") - F.col("raw")).otherwise(0.0))
    return g.select("year", F.round(F.col("raw") + F.col("comp"), 3).alias("level"), F.round(F.sqrt(0.09 + F.pow(0.5 * F.col("comp"), 2)), 4).alias("half"))


@query("""
WITH p AS (SELECT cell_id, year, lst, lag(lst) OVER (PARTITION BY cell_id ORDER BY year) AS last, avg(lst) OVER (PARTITION BY cell_id ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM obs)
SELECT year, count(*) AS n, round(sqrt(avg((past - lst) ** 2)), 3) AS rmse, round(sqrt(avg((last - lst) ** 2)), 3) AS persistence, round(1 - sqrt(avg((past - lst) ** 2)) / sqrt(avg((last - lst) ** 2)), 5) + 0.0 AS skill
FROM p WHERE last IS NOT NULL GROUP BY year HAVING count(*) >= 3""")
def q_hindcast(spark, sf):
    """Error of the mean of earlier frames against persistence, and the skill."""
    w = Window.partitionBy("cell_id").orderBy("year")
    p = cube.observations(spark, sf).withColumn("last", F.lag("lst").over(w)).withColumn("past", F.avg("lst").over(w.rowsBetween(Window.unboundedPreceding, -1))).filter("last is not null")
    rmse = lambda c: F.sqrt(F.avg(F.pow(F.col(c) - F.col("lst"), 2)))
    g = p.groupBy("year").agg(F.count(F.lit(1)).alias("n"), rmse("past").alias("a"), rmse("last").alias("b")).filter("n >= 3")
    return g.select("year", "n", R(F.col("a"), 3).alias("rmse"), R(F.col("b"), 3).alias("persistence"), R(1 - F.col("a") / F.col("b"), 5).alias("skill"))


@query("""
WITH m AS (SELECT quantile_cont(elev, 0.5) AS m FROM cells WHERE district % 5 <> 0 AND cell_id % 7 <> 0) SELECT cell_id, round(CASE WHEN cell_id % 7 <> 0 THEN elev ELSE m END, 3) AS elev FROM cells, m""")
def q_median_impute(spark, sf):
    """Missing values take the median of the training rows only."""
    c = cube.cells(spark, sf).withColumn("x", F.when(F.col("cell_id") % 7 != 0, F.col("elev")))
    m = order.quantiles(c.filter("district % 5 <> 0"), [], F.col("x"), [0.5]).select(F.col("q")[0])
    return c.select("cell_id", F.round(F.coalesce("x", m.scalar()), 3).alias("elev"))


# What-if, resampling ---------------------------------------------------------------


@query("""
WITH f AS (SELECT cell_id, built, least(1, built + 0.15) AS b2, 0.6 - 0.5 * built AS ndvi FROM cells)
SELECT cell_id, round(b2, 5) AS built, round(greatest(-1, least(1, ndvi - 0.4 * (b2 - built))), 5) + 0.0 AS ndvi, round(greatest(-1, least(1, ndvi + 0.1 - 0.4 * (b2 - built))) - greatest(-1, least(1, ndvi - 0.4 * (b2 - built))), 5) + 0.0 AS drop FROM f""")
def q_perturb(spark, sf):
    """A bounded step of one share; the coupled index follows by its slope, and what is derived from it anew."""
    c = cube.cells(spark, sf).select("cell_id", "built", F.least(F.lit(1.0), F.col("built") + 0.15).alias("b2"), (0.6 - 0.5 * F.col("built")).alias("ndvi"))
    follow = lambda x: S.clip(x - 0.4 * (F.col("b2") - F.col("built")), -1.0, 1.0)
    return c.select("cell_id", R(F.col("b2"), 5).alias("built"), R(follow(F.col("ndvi")), 5).alias("ndvi"), R(follow(F.col("ndvi") + 0.1) - follow(F.col("ndvi")), 5).alias("drop"))


_U = "(((({a} * 73856093 + {b} * 19349663) % 2147483647) * (({a} * 83492791 + {b} * 2654435) % 1000003 + 1)) % 2147483647) / 2147483647.0::DOUBLE"


@query(f"""
WITH b AS (SELECT row // 5 * 5 + col // 5 AS block, sum(elev) AS s, count(*) AS n FROM cells GROUP BY 1),
r AS (SELECT rep, block, s, n, floor(3 * {_U.format(a="block", b="rep")}) AS w FROM b, range(1, 41) t(rep)), m AS (SELECT rep, sum(w * s) / nullif(sum(w * n), 0) AS m FROM r GROUP BY rep)
SELECT round(quantile_cont(m, 0.05), 3) AS lo, round(quantile_cont(m, 0.5), 3) AS mid, round(quantile_cont(m, 0.95), 3) AS hi, count(m) AS replicates FROM m""")
def q_block_bootstrap(spark, sf):
    """Interval of a mean from replicates that weight whole blocks by portable draws; blocks are summed before they are repeated."""
    b = cube.cells(spark, sf).groupBy(grid.block_id(5, cube.WIDTH).alias("block")).agg(F.sum("elev").alias("s"), F.count(F.lit(1)).alias("n"))
    r = b.withColumn("rep", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(40).cast("long")))).withColumn("w", F.floor(3 * S.unit_hash(F.col("block"), F.col("rep"))))
    m = r.groupBy("rep").agg(F.try_divide(F.sum(F.col("w") * F.col("s")), F.sum(F.col("w") * F.col("n"))).alias("m"))
    q = m.agg(F.percentile("m", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("q"), F.count("m").alias("replicates"))
    return q.select(*[F.round(F.col("q")[i], 3).alias(c) for i, c in enumerate(("lo", "mid", "hi"))], "replicates")


# Timeline and serving reads --------------------------------------------------------


@query("""
WITH f AS (SELECT year, count(*) AS n, avg(n) AS passes FROM obs GROUP BY year)
SELECT year, year + 0.5::DOUBLE AS t_mid, CASE WHEN passes >= 4 THEN 'observed' WHEN passes >= 2 THEN 'observed-sparse' ELSE 'modelled' END AS tier, CASE WHEN passes >= 4 THEN 0.3 WHEN passes >= 2 THEN 0.45 ELSE 1.5 END::DOUBLE AS half, n < 100 AS sparse FROM f""")
def q_evidence_tiers(spark, sf):
    """Evidence tier, window midpoint and half-width of each frame."""
    f = cube.observations(spark, sf).groupBy("year").agg(F.count(F.lit(1)).alias("m"), F.avg("n").alias("passes"))
    tier = lambda a, b, c: F.when(F.col("passes") >= 4, a).when(F.col("passes") >= 2, b).otherwise(c)
    return f.select("year", (F.col("year") + F.lit(0.5)).alias("t_mid"), tier("observed", "observed-sparse", "modelled").alias("tier"), tier(0.3, 0.45, 1.5).alias("half"), (F.col("m") < 100).alias("sparse"))


@query("""
WITH b AS (SELECT scope, avg(value) FILTER (WHERE year = 1995 AND scope % 3 = 0) AS own, avg(value) FILTER (WHERE year = 1999 AND scope % 3 = 1) AS p50, avg(value) FILTER (WHERE year >= 2000) AS late FROM annual GROUP BY scope),
l AS (SELECT avg(value) AS level FROM annual) SELECT scope, round(coalesce(own, p50 - 1000, level), 2) AS baseline, round(late - coalesce(own, p50 - 1000, level), 2) + 0.0 AS change FROM b, l""")
def q_scope_baseline(spark, sf):
    """Baseline of a scope: its own, else the projection less its total, else the region's level; and the change from it."""
    a = cube.annual(spark, sf)
    pick = lambda c: F.avg(F.when(c, F.col("value")))
    s, y = F.col("scope"), F.col("year")
    b = a.groupBy("scope").agg(pick((y == 1995) & (s % 3 == 0)).alias("own"), pick((y == 1999) & (s % 3 == 1)).alias("p50"), pick(y >= 2000).alias("late"))
    base = F.coalesce("own", F.col("p50") - 1000, a.select(F.avg("value")).scalar())
    return b.select("scope", R(base, 2).alias("baseline"), R(F.col("late") - base, 2).alias("change"))


@query("SELECT scope, round(value - avg(value) OVER (PARTITION BY year), 2) + 0.0 AS anomaly, round(value, 2) AS value FROM annual WHERE year = 1997")
def q_context_anomaly(spark, sf):
    """A frame's scopes against the region in the same frame."""
    a = cube.annual(spark, sf).filter("year = 1997")
    return a.select("scope", R(F.col("value") - a.select(F.avg("value")).scalar(), 2).alias("anomaly"), R(F.col("value"), 2).alias("value"))


@query("""SELECT cell_id, year, round(lst, 3) AS p50, round(lst - 3.0 / n, 3) AS p05, round(lst + 3.0 / n, 3) AS p95 FROM obs WHERE cell_id IN (7, 31)""")
def q_cell_values(spark, sf):
    """Cells through time with their quantiles; the filter reaches the scan."""
    o = cube.observations(spark, sf).filter(F.col("cell_id").isin(7, 31))
    return o.select("cell_id", "year", F.round("lst", 3).alias("p50"), F.round(F.col("lst") - 3.0 / F.col("n"), 3).alias("p05"), F.round(F.col("lst") + 3.0 / F.col("n"), 3).alias("p95"))


@query("""
WITH c AS (SELECT cls, sqrt(avg((lst - elev) ** 2)) AS rmse, stddev_pop(lst) AS base FROM obs JOIN cells USING (cell_id) GROUP BY cls)
SELECT cls, round(1 - rmse / nullif(base, 0), 4) + 0.0 AS gain, round(rmse * rmse / sum(rmse * rmse) OVER (), 5) AS share FROM c""")
def q_honest_skill(spark, sf):
    """Skill over the baseline by class, and each class's share of the squared error (a few rows)."""
    c = _joined(spark, sf).groupBy("cls").agg(F.sqrt(F.avg(F.pow(F.col("lst") - F.col("elev"), 2))).alias("rmse"), F.stddev_pop("lst").alias("base"))
    sq = F.col("rmse") * F.col("rmse")
    return c.select("cls", R(1 - F.try_divide("rmse", "base"), 4).alias("gain"), R(sq / F.sum(sq).over(Window.partitionBy()), 5).alias("share"))


# Sinks -----------------------------------------------------------------------------


@query("SELECT year, count(*) AS n, round(sum(w), 2) AS w FROM obs GROUP BY year")
def q_partitioned_parquet(spark, sf):
    """Written as zstd Parquet, partitioned by frame, and read back."""
    path = new_path(spark, "products")
    cube.observations(spark, sf).repartition("year").write.option("compression", "zstd").partitionBy("year").parquet(path)
    back = spark.read.schema("cell_id long, lst double, w double, n long, year long").parquet(path)
    return back.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("w"), 2).alias("w"))


@query("SELECT scope, year, round(value, 2) AS value FROM annual")
def q_timeline_csv(spark, sf):
    """Timelines written as CSV with a header and read back."""
    path = new_path(spark, "products")
    cube.annual(spark, sf).select("scope", "year", R(F.col("value"), 2).alias("value")).write.csv(path, header=True)
    return spark.read.csv(path, header=True, schema="scope long, year long, value double")


@query("SELECT scope, json_array_length(to_json(list({'year': year, 'value': value})))::BIGINT AS entries, min(year) AS first_year FROM annual GROUP BY scope")
def q_series_documents(spark, sf):
    """Nested series documents as strict JSON (NaN and infinity become null), parsed again."""
    v = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    d = cube.annual(spark, sf).groupBy("scope").agg(F.to_json(F.array_sort(F.collect_list(F.struct("year", v.alias("value"))))).alias("doc"))
    back = F.from_json("doc", "array<struct<year: bigint, value: double>>", {"mode": "FAILFAST"})
    return d.select("scope", F.size(back).cast("long").alias("entries"), F.array_min(F.transform(back, lambda e: e["year"])).alias("first_year"))
