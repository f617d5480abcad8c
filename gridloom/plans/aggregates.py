"""Grouped statistics of the cube."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import agg, order, spatial
from ..operators.scratch import stored
from ..sources import cube
from .registry import query

R = S.fixed
HOT = 1500.0


@query(f"""
SELECT scope, year, round(avg(lst), 4) AS mean, round(quantile_cont(lst, 0.9), 4) AS p90, count(*) AS n,
       round(avg(CASE WHEN lst >= {HOT} THEN 1.0 ELSE 0.0 END), 6) AS hot_share
FROM (SELECT o.year, o.lst, unnest(['region', 'd:' || c.district]) AS scope FROM obs o JOIN cells c USING (cell_id)) GROUP BY ALL""")
def q_frame_stats(spark, sf):
    c = cube.cells(spark, sf).select("cell_id", "district")
    o = cube.observations(spark, sf).join(c, "cell_id")
    b = agg.scope_bridge(o, {"region": F.lit("region"), "district": F.concat(F.lit("d:"), F.col("district").cast("string"))})
    s = agg.frame_stats(b, "lst", HOT)
    return s.select("scope", "year", R(F.col("mean")).alias("mean"), R(F.col("p90")).alias("p90"), "n", R(F.col("hot_share"), 6).alias("hot_share"))


@query("""
SELECT row // 4 AS pr, col // 4 AS pc, year, CASE WHEN count(lst) >= 0.5 * 16 THEN round(avg(lst), 4) END AS mean, count(lst) AS n
FROM obs JOIN cells USING (cell_id) GROUP BY ALL""")
def q_block_mean_min_valid(spark, sf):
    d = cube.observations(spark, sf).join(cube.cells(spark, sf), "cell_id").withColumn("pr", F.floor(F.col("row") / 4).cast("long")).withColumn("pc", F.floor(F.col("col") / 4).cast("long"))
    return agg.block_mean(d, ["pr", "pc", "year"], "lst", 16, 0.5).withColumn("mean", R(F.col("mean")))


@query("SELECT row // 5 AS pr, col // 5 AS pc, CASE WHEN count(*) > 1 THEN round(stddev_pop(elev), 4) END AS std FROM cells GROUP BY ALL")
def q_block_std(spark, sf):
    d = cube.cells(spark, sf).withColumn("pr", F.floor(F.col("row") / 5).cast("long")).withColumn("pc", F.floor(F.col("col") / 5).cast("long"))
    return agg.block_std(d, ["pr", "pc"], "elev").withColumn("std", R(F.col("std")))


@query("""
WITH d AS (SELECT cell_id, year, CAST(ts AS DATE) AS day, avg(v) AS v FROM pixels GROUP BY ALL)
SELECT cell_id, year, CASE WHEN count(*) >= 2 THEN round(quantile_cont(v, 0.5) + 1e-7, 4) END AS median, count(*) AS n_days FROM d GROUP BY ALL""")
def q_median_composite(spark, sf):
    m = agg.median_composite(cube.pixels(spark, sf), ["cell_id", "year"], F.to_date("ts"), "v", 2)
    return m.withColumn("median", R(F.col("median") + 1e-7))


@query("SELECT year, round(count(*) / (SELECT count(*)::DOUBLE FROM cells), 6) AS coverage FROM obs GROUP BY year HAVING count(*) / (SELECT count(*)::DOUBLE FROM cells) >= 0.3")
def q_coverage_having(spark, sf):
    total = cube.cells(spark, sf).select(F.count(F.lit(1)).cast("double"))
    g = cube.observations(spark, sf).groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("coverage", R(F.col("n") / total.scalar(), 6)).filter(F.col("n") / total.scalar() >= 0.3).select("year", "coverage")


@query("SELECT cell_id FROM obs WHERE year IN (1996, 1997) GROUP BY cell_id HAVING count(DISTINCT year) = 2")
def q_fixed_mask_division(spark, sf):
    o = cube.observations(spark, sf)
    return agg.in_all_frames(o, "cell_id", "year", F.col("lst").isNotNull(), o.filter("year in (1996, 1997)").select("year").distinct())


METRICS = """count(*) AS n, round(1 - sum(w * (p - y) ** 2) / (sum(w * y * y) - sum(w * y) ** 2 / sum(w)), 4) + 0.0 AS r2, round(sqrt(sum(w * (p - y) ** 2) / sum(w)), 4) AS rmse,
 round(sum(w * abs(p - y)) / sum(w), 4) AS mae, round(sum(w * (p - y)) / sum(w), 4) + 0.0 AS bias"""


def _predicted(spark, sf):
    o = cube.observations(spark, sf).join(cube.cells(spark, sf), "cell_id")
    return o.select("cell_id", "year", "cls", F.col("lst").alias("y"), F.col("elev").alias("p"), "w")


def _rounded(df):
    return df.select(*[R(F.col(c)).alias(c) if c in ("r2", "rmse", "mae", "bias") else F.col(c) for c in df.columns])


@query(f"WITH t AS (SELECT year, cls, lst AS y, elev AS p, w FROM obs JOIN cells USING (cell_id)) SELECT year, {METRICS} FROM t GROUP BY year HAVING count(*) >= 2")
def q_weighted_metrics(spark, sf):
    return _rounded(agg.weighted_metrics(_predicted(spark, sf), ["year"], "y", "p", "w"))


@query(f"WITH t AS (SELECT year, cls, lst AS y, elev AS p, w FROM obs JOIN cells USING (cell_id)) SELECT cls, {METRICS} FROM t GROUP BY cls HAVING count(*) >= 20")
def q_metrics_by_class(spark, sf):
    return _rounded(agg.weighted_metrics(_predicted(spark, sf), ["cls"], "y", "p", "w", 20))


@query("""
WITH q AS (SELECT quantile_cont(lst, 0.9) AS t FROM obs WHERE year BETWEEN 1995 AND 1997)
SELECT year, count(*) FILTER (WHERE lst >= (SELECT t FROM q) - 0.00001) AS hot_cells FROM obs GROUP BY year""")
def q_hot_core(spark, sf):
    """Cells at or above the reference period's p90."""
    o = cube.observations(spark, sf)
    t = order.quantiles(o.filter("year between 1995 and 1997"), [], F.col("lst"), [0.9]).select(F.col("q")[0])
    return o.groupBy("year").agg(F.count_if(F.col("lst") >= t.scalar() - 0.00001).alias("hot_cells"))


@query("""
SELECT year, CASE WHEN count(*) FILTER (WHERE built >= 0.5) >= 3 AND count(*) FILTER (WHERE built <= 0.1) >= 3
       THEN round(avg(lst) FILTER (WHERE built >= 0.5) - avg(lst) FILTER (WHERE built <= 0.1), 4) + 0.0 END AS uhi FROM obs JOIN cells USING (cell_id) GROUP BY year""")
def q_uhi(spark, sf):
    """Urban minus rural mean, where both have at least three cells."""
    d = cube.observations(spark, sf).join(cube.cells(spark, sf), "cell_id")
    u, r = F.col("built") >= 0.5, F.col("built") <= 0.1
    v = F.avg(F.when(u, F.col("lst"))) - F.avg(F.when(r, F.col("lst")))
    return d.groupBy("year").agg(F.when((F.count_if(u) >= 3) & (F.count_if(r) >= 3), R(v)).alias("uhi"))


@query("""SELECT floor(quantile_cont(v, 0.005)) AS lo, ceil(quantile_cont(v, 0.995)) AS hi FROM (SELECT lst AS v FROM obs UNION ALL SELECT elev FROM cells)""")
def q_domains_quantiles(spark, sf):
    """Display domain over the union of products, rounded outwards."""
    v = cube.observations(spark, sf).select(F.col("lst").alias("v")).unionByName(cube.cells(spark, sf).select(F.col("elev").alias("v")))
    q = order.quantiles(v, [], F.col("v"), [0.005, 0.995])
    return q.select(F.floor(F.col("q")[0]).cast("double").alias("lo"), F.ceil(F.col("q")[1]).cast("double").alias("hi"))


@query("""
WITH z AS (SELECT user_id, CAST(ts AS DATE) AS day, arg_max(event_type, (ts, event_id)) AS zone FROM events GROUP BY ALL),
p AS (SELECT zone AS from_state, lead(zone) OVER (PARTITION BY user_id ORDER BY day) AS to_state FROM z),
n AS (SELECT from_state, to_state, count(*) AS n FROM p WHERE to_state IS NOT NULL GROUP BY ALL)
SELECT from_state, to_state, n, round(n / sum(n) OVER (PARTITION BY from_state), 6) AS share FROM n""")
def q_transition_matrix(spark, sf):
    e = cube.table(spark, sf, "events")
    z = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("zone"))
    return agg.transitions(z, "user_id", "day", "zone").withColumn("share", R(F.col("share"), 6))


@query("""
WITH s AS (SELECT year, cls, count(*) AS n FROM obs JOIN cells USING (cell_id) GROUP BY ALL)
SELECT year, cls, n, round(n / sum(n) OVER (PARTITION BY year), 6) AS share, n - lag(n) OVER (PARTITION BY cls ORDER BY year) AS change FROM s""")
def q_zone_share(spark, sf):
    s = cube.observations(spark, sf).join(cube.cells(spark, sf), "cell_id").groupBy("year", "cls").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("year"))
    return s.withColumn("share", R(share, 6)).withColumn("change", F.col("n") - F.lag("n").over(Window.partitionBy("cls").orderBy("year")))


@query("""
WITH a AS (SELECT vec_id, list_transform(embedding, lambda x: abs(x)) AS v FROM embeddings)
SELECT vec_id, list_position(v, list_max(v))::BIGINT - 1 AS driver, round(list_max(v)::DOUBLE, 5) AS strength FROM a""", cube=False)
def q_dominant_driver(spark, sf):
    return spatial.dominant(cube.table(spark, sf, "embeddings"), "vec_id", "embedding").select("vec_id", "driver", R(F.col("strength"), 5).alias("strength"))


@query("""
WITH h AS (SELECT cell_id, elev, cls, row // 3 AS hr, (col + (row // 3 % 2) * 2) // 4 AS hc FROM cells),
g AS (SELECT hr, hc, cls, count(*) AS n FROM h GROUP BY ALL), m AS (SELECT *, row_number() OVER (PARTITION BY hr, hc ORDER BY n DESC, cls) AS r FROM g)
SELECT h.hr, h.hc, round(avg(elev), 4) AS mean, any_value(m.cls) AS mode FROM h JOIN m ON m.hr = h.hr AND m.hc = h.hc AND r = 1 GROUP BY h.hr, h.hc""")
def q_hexbin_mean_mode(spark, sf):
    """Offset (brick) bins: mean, and mode with ties to the lowest code."""
    hr = F.floor(F.col("row") / 3).cast("long")
    h = cube.cells(spark, sf).withColumn("hr", hr).withColumn("hc", F.floor((F.col("col") + (F.col("hr") % 2) * 2) / 4).cast("long"))
    mode = agg.mode_lowest(h, ["hr", "hc"], "cls").select("hr", "hc", F.col("cls").alias("mode"))
    return h.groupBy("hr", "hc").agg(R(F.avg("elev")).alias("mean")).join(mode, ["hr", "hc"])


@query("""
WITH r AS (SELECT min(elev) AS lo, max(elev) AS hi FROM cells)
SELECT least(23, CAST(floor((elev - lo) / ((hi - lo) / 24)) AS BIGINT)) AS bin, count(*) AS n,
       round(any_value(lo) + least(23, CAST(floor((elev - lo) / ((hi - lo) / 24)) AS BIGINT)) * ((any_value(hi) - any_value(lo)) / 24), 4) AS left_edge FROM cells, r GROUP BY 1""")
def q_histogram24(spark, sf):
    return agg.histogram(cube.cells(spark, sf), "elev", 24).withColumn("left_edge", R(F.col("left_edge")))


@query("""

WITH b AS (SELECT row // 5 AS pr, col // 5 AS pc, cls, count(*) AS n FROM cells GROUP BY ALL)
SELECT pr, pc, cls, round(n / sum(n) OVER (PARTITION BY pr, pc), 6) AS fraction FROM b""")
def q_class_fractions(spark, sf):
    b = cube.cells(spark, sf).groupBy(F.floor(F.col("row") / 5).cast("long").alias("pr"), F.floor(F.col("col") / 5).cast("long").alias("pc"), "cls").agg(F.count(F.lit(1)).alias("n"))
    return b.select("pr", "pc", "cls", R(F.col("n") / F.sum("n").over(Window.partitionBy("pr", "pc")), 6).alias("fraction"))


@query("SELECT n_regionkey::BIGINT AS region, scope, count(*) AS n, round(avg(value), 2) AS mean FROM annual JOIN nation ON n_nationkey = scope GROUP BY ROLLUP (n_regionkey::BIGINT, scope)")
def q_rollup_scopes(spark, sf):
    n = cube.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("scope"), F.col("n_regionkey").cast("long").alias("region"))
    return cube.annual(spark, sf).join(n, "scope").rollup("region", "scope").agg(F.count(F.lit(1)).alias("n"), R(F.avg("value"), 2).alias("mean"))


@query("""SELECT year, round(min(lst), 4) AS lo, round(quantile_cont(lst, 0.01), 4) AS p01, round(quantile_cont(lst, 0.5), 4) AS p50, round(quantile_cont(lst, 0.99), 4) AS p99, round(max(lst), 4) AS hi,
 round(avg(lst), 4) AS mean, round(stddev_samp(lst), 4) AS sd, count(*) AS n FROM obs GROUP BY year""")
def q_feature_stats(spark, sf):
    o = stored(cube.observations(spark, sf).select("year", "lst"), "observations")
    g = o.groupBy("year").agg(R(F.min("lst")).alias("lo"), R(F.max("lst")).alias("hi"), R(F.avg("lst")).alias("mean"), R(F.stddev_samp("lst")).alias("sd"), F.count(F.lit(1)).alias("n"))
    q = order.quantiles(o, ["year"], F.col("lst"), [0.01, 0.5, 0.99]).select("year", *[R(F.col("q")[i]).alias(p) for i, p in enumerate(("p01", "p50", "p99"))])
    return g.join(q, "year")


@query("""
WITH d AS (SELECT c.district, count(*) AS n, avg(o.lst) AS mean, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM obs o JOIN cells c USING (cell_id) GROUP BY 1)
SELECT district, n, round(mean, 4) AS mean, r0, r1, c0, c1, rank() OVER (ORDER BY round(mean, 4), district) AS coolest FROM d""")
def q_district_summary(spark, sf):
    """Districts are a fixed few; only their summary rows are ranked together."""
    g = cube.observations(spark, sf).join(cube.cells(spark, sf), "cell_id").groupBy("district")
    s = g.agg(F.count(F.lit(1)).alias("n"), R(F.avg("lst")).alias("mean"), F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    return s.withColumn("coolest", F.rank().over(Window.orderBy("mean", "district")).cast("long"))


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""", cube=False)
def q_pricing_summary(spark, sf):
    li = cube.table(spark, sf, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), R(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), R(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("""
WITH p AS (SELECT cell_id, year, avg(v) AS m, count(*) AS n, sum(w) AS sw, sum(w * v) / sum(w) AS wm FROM pixels GROUP BY ALL)
SELECT (year - 1995) // 5 AS block, cell_id, round(sum(n * m) / sum(n), 4) AS mean FROM p GROUP BY ALL""")
def q_weighted_blocks(spark, sf):
    """n-weighted mean of five-year blocks from annual means."""
    p = cube.pixels(spark, sf).groupBy("cell_id", "year").agg(F.avg("v").alias("m"), F.count(F.lit(1)).alias("n"))
    return p.groupBy(F.floor((F.col("year") - 1995) / 5).cast("long").alias("block"), "cell_id").agg(R(F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"))
