"""What-if, allocation, downscaling, Monte-Carlo, validation, file format and streaming queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import agg, scenario, spatial
from ..sources import cube
from .registry import query

R = S.fixed


@query("""
WITH f AS (SELECT cell_id, built * 0.5 AS a, 0.2 AS b, (1 - built) * 0.2 AS c FROM cells), h AS (SELECT *, b + c + greatest(0, 1 - (a + b + c)) AS held FROM f),
s AS (SELECT *, greatest(least(0.25, 1 - a, held), -a) AS step FROM h)
SELECT cell_id, round(a + step, 6) AS a, round(b - step * b / held, 6) AS b, round(c - step * c / held, 6) + 0.0 AS c FROM s""")
def q_rebalance(spark, sf):
    f = cube.cells(spark, sf).select("cell_id", (F.col("built") * 0.5).alias("a"), F.lit(0.2).alias("b"), ((1 - F.col("built")) * 0.2).alias("c"))
    new = scenario.rebalance(["a", "b", "c"], "a", F.lit(0.25))
    return f.select("cell_id", *[R(new[k], 6).alias(k) for k in ("a", "b", "c")])


@query("""
WITH w AS (SELECT cell_id, district, built, least(1, built + 0.2) AS plus, elev FROM cells),
e AS (SELECT district, (CASE WHEN plus < 0.5 THEN -0.4 ELSE 0.7 END) - (CASE WHEN built < 0.5 THEN -0.4 ELSE 0.7 END) AS d FROM w)
SELECT district, round(avg(d), 6)::DOUBLE AS mean_delta, count(*) FILTER (WHERE abs(d) > 1e-6) AS changed, count(*) AS n FROM e GROUP BY district""")
def q_whatif_delta(spark, sf):
    """Change of a model's prediction when built-up shares rise by 0.2, by district."""
    tree = {"feature": 0, "threshold": 0.5, "left": {"leaf": -0.4}, "right": {"leaf": 0.7}}
    plus = F.least(F.lit(1.0), F.col("built") + 0.2)
    d = scenario.ensemble([tree], 0.0, [plus]) - scenario.ensemble([tree], 0.0, [F.col("built")])
    return cube.cells(spark, sf).withColumn("d", d).groupBy("district").agg(R(F.avg("d"), 6).alias("mean_delta"), F.count_if(F.abs("d") > 1e-6).alias("changed"), F.count(F.lit(1)).alias("n"))


@query("""
WITH c AS (SELECT cell_id, district, (1 - built) AS cap, elev / 1000 AS a, 0.3 * sum(1 - built) OVER (PARTITION BY district) AS demand FROM cells),
r AS (SELECT *, cap / a AS ratio FROM c WHERE a > 0),
p AS (SELECT *, coalesce(sum(cap) OVER (PARTITION BY district ORDER BY ratio, cell_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled, sum(a) OVER (PARTITION BY district ORDER BY ratio, cell_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS opened FROM r),
k AS (SELECT district, arg_min((demand - filled) / opened, (ratio, cell_id)) FILTER (WHERE (demand - filled) / opened <= ratio) AS k FROM p GROUP BY district)
SELECT cell_id, round(least(cap, greatest(k, 0) * a), 5) AS allocated FROM p JOIN k USING (district)""")
def q_alloc_bisection(spark, sf):
    d = cube.cells(spark, sf).select("cell_id", "district", (1 - F.col("built")).alias("cap"), (F.col("elev") / 1000).alias("a"))
    d = d.withColumn("demand", 0.3 * F.sum("cap").over(Window.partitionBy("district")))
    return scenario.allocate(d, "district", "cap", "a", "demand").select("cell_id", R(F.col("allocated"), 5).alias("allocated"))


@query("""
WITH g AS (SELECT district, count(*) FILTER (WHERE built > 0.5 AND elev > 1400) AS hits, count(*) FILTER (WHERE built > 0.5 AND NOT elev > 1400) AS misses, count(*) FILTER (WHERE NOT built > 0.5 AND elev > 1400) AS false_alarms, count(*) AS n FROM cells GROUP BY district)
SELECT district, hits, misses, false_alarms, round(hits / nullif(hits + misses + false_alarms, 0)::DOUBLE, 6) AS merit, round(abs(misses - false_alarms) / n::DOUBLE, 6) AS quantity, round(2 * least(misses, false_alarms) / n::DOUBLE, 6) AS allocation FROM g""")
def q_change_metrics(spark, sf):
    m = scenario.change_metrics(cube.cells(spark, sf), "district", F.col("built") > 0.5, F.col("elev") > 1400)
    return m.select("district", "hits", "misses", "false_alarms", *[R(F.col(c), 6).alias(c) for c in ("merit", "quantity", "allocation")])


@query("SELECT cell_id, round(elev * (1.2 * (built + 0.02) / (built * 0.9 + 0.02)) * sum(elev) OVER () / sum(elev * (1.2 * (built + 0.02) / (built * 0.9 + 0.02))) OVER (), 4) AS pop FROM cells")
def q_pop_rule(spark, sf):
    """Population grows with built-up share and is renormalised to the total (one row of totals)."""
    c = cube.cells(spark, sf).withColumn("p", F.col("elev") * (1.2 * (F.col("built") + 0.02) / (F.col("built") * 0.9 + 0.02)))
    t = c.agg(F.sum("elev").alias("a"), F.sum("p").alias("b")).select(F.try_divide("a", "b"))
    return c.select("cell_id", R(F.col("p") * t.scalar()).alias("pop"))


@query("WITH p AS (SELECT *, row // 5 * 5 + col // 5 AS block FROM cells) SELECT cell_id, round(elev + (avg(built) OVER (PARTITION BY block) * 100 - avg(elev) OVER (PARTITION BY block)), 4) + 0.0 AS conserved FROM p")
def q_dms_conserve(spark, sf):
    c = cube.cells(spark, sf).withColumn("block", (F.floor(F.col("row") / 5) * 5 + F.floor(F.col("col") / 5)).cast("long"))
    c = c.withColumn("target", F.avg("built").over(Window.partitionBy("block")) * 100)
    return scenario.conserve(c, "block", "elev", "target").select("cell_id", R(F.col("conserved")).alias("conserved"))


@query()
def q_mc_quantiles(spark, sf):
    c = cube.cells(spark, sf).select("cell_id", F.col("elev").alias("base"), (F.col("built") * 10).alias("spread"))
    return scenario.monte_carlo(c, 200, 11)


@query("""
WITH d AS (SELECT district, k, elev, ((((cell_id * 73856093 + k * 19349663) % 2147483647) * ((cell_id * 83492791 + k * 2654435) % 1000003 + 1)) % 2147483647) / 2147483647.0::DOUBLE AS u FROM cells, range(1, 21) r(k)),
m AS (SELECT district, k, avg(elev + 10 * u) AS m, avg(10 * u) AS e FROM d GROUP BY ALL)
SELECT district, round(avg(m), 3) AS mean, round(var_pop(e), 5) AS variance FROM m GROUP BY district""")
def q_variance_budget(spark, sf):
    """Spread of district means over 20 portable draws."""
    d = scenario.draws(cube.cells(spark, sf), 20, "cell_id")
    m = d.groupBy("district", "draw").agg(F.avg(F.col("elev") + 10 * F.col("u")).alias("m"), F.avg(10 * F.col("u")).alias("e"))
    return m.groupBy("district").agg(R(F.avg("m"), 3).alias("mean"), R(F.var_pop("e"), 5).alias("variance"))


@query("""
WITH t AS (SELECT scope, regr_slope(value, year) AS b, regr_intercept(value, year) AS a FROM annual GROUP BY scope)
SELECT scope, min(y) AS first_year FROM t, range(2002, 2101, 7) r(y) WHERE a + b * y > 200000 GROUP BY scope""")
def q_threshold_years(spark, sf):
    t = cube.annual(spark, sf).groupBy("scope").agg(F.regr_slope("value", "year").alias("b"), F.regr_intercept("value", "year").alias("a"))
    years = F.filter(F.sequence(F.lit(2002).cast("long"), F.lit(2100).cast("long"), F.lit(7).cast("long")), lambda y: F.col("a") + F.col("b") * y > 200000)
    return t.select("scope", F.array_min(years).alias("first_year")).filter("first_year is not null")


@query("""
WITH p AS (SELECT scope, avg(value) FILTER (WHERE year = 1995) AS y1995, avg(value) FILTER (WHERE year = 1998) AS y1998, avg(value) FILTER (WHERE year = 2000) AS y2000 FROM annual GROUP BY scope)
SELECT scope, round(y1998 - y1995, 2) + 0.0 AS d1998, round(y2000 - y1995, 2) + 0.0 AS d2000 FROM p WHERE y1995 IS NOT NULL AND y1998 IS NOT NULL AND y2000 IS NOT NULL""")
def q_cmip_delta_pivot(spark, sf):
    """Deltas against a baseline frame, complete scopes only."""
    p = cube.annual(spark, sf).groupBy("scope").pivot("year", [1995, 1998, 2000]).agg(F.avg("value")).dropna()
    return p.select("scope", R(F.col("1998") - F.col("1995"), 2).alias("d1998"), R(F.col("2000") - F.col("1995"), 2).alias("d2000"))


@query("""
WITH c AS (SELECT district, s AS step, round(avg(-s * built - elev / 100000), 5) AS effect FROM cells, (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE), (1.0::DOUBLE)) v(s) GROUP BY ALL),
b AS (SELECT *, min(effect) OVER (PARTITION BY district) AS best FROM c), f AS (SELECT district, step, effect, row_number() OVER (PARTITION BY district ORDER BY step) AS r FROM b WHERE effect <= 0.9 * best AND effect < -0.05)
SELECT district, step, effect, CASE WHEN effect <= -1.0 THEN 'high' WHEN effect <= -0.3 THEN 'medium' ELSE 'low' END AS priority FROM f WHERE r = 1""")
def q_recommend_topk(spark, sf):
    """Smallest step that reaches nine tenths of the best cooling."""
    c = cube.cells(spark, sf).withColumn("step", F.explode(F.array(*[F.lit(s) for s in (0.25, 0.5, 0.75, 1.0)])))
    c = c.groupBy("district", "step").agg(R(F.avg(-F.col("step") * F.col("built") - F.col("elev") / 100000), 5).alias("effect"))
    c = c.withColumn("best", F.min("effect").over(Window.partitionBy("district"))).filter("effect <= 0.9 * best and effect < -0.05")
    c = c.groupBy("district").agg(F.min_by(F.struct("step", "effect"), "step").alias("s")).select("district", "s.*")
    return c.withColumn("priority", F.when(F.col("effect") <= -1.0, "high").when(F.col("effect") <= -0.3, "medium").otherwise("low"))


@query("""
WITH a AS (SELECT o.cell_id, o.lst AS a, p.lst AS b, (o.cell_id % 10) / 9.0::DOUBLE AS m FROM obs o JOIN obs p ON o.cell_id = p.cell_id AND o.year = 1996 AND p.year = 1997)
SELECT cell_id, round(CASE WHEN m <= 0 THEN a WHEN m >= 1 THEN b ELSE a + (b - a) * m END, 4) AS mixed FROM a""")
def q_mix_frames(spark, sf):
    o = cube.observations(spark, sf)
    a, b = o.filter("year = 1996").select("cell_id", F.col("lst").alias("a")), o.filter("year = 1997").select("cell_id", F.col("lst").alias("b"))
    return a.join(b, "cell_id").select("cell_id", R(S.lerp(F.col("a"), F.col("b"), (F.col("cell_id") % 10) / F.lit(9.0))).alias("mixed"))


# Checks: each is a query that should return no row -------------------------------


@query("SELECT vec_id FROM embeddings WHERE abs(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) - (list_sum(list_transform(embedding[1:32], lambda x: x::DOUBLE)) + list_sum(list_transform(embedding[33:], lambda x: x::DOUBLE)))) > 0.001", cube=False)
def q_check_waterfall(spark, sf):
    """Additivity of contributions split in two halves."""
    e = cube.table(spark, sf, "embeddings")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double"))
    off = total(F.col("embedding")) - (total(F.slice("embedding", 1, 32)) + total(F.slice("embedding", F.lit(33), F.size("embedding"))))
    return e.filter(F.abs(off) > 0.001).select("vec_id")


@query("SELECT year FROM obs GROUP BY year HAVING NOT (quantile_cont(lst, 0.05) <= quantile_cont(lst, 0.5) AND quantile_cont(lst, 0.5) <= quantile_cont(lst, 0.95))")
def q_check_quantile_order(spark, sf):
    q = cube.observations(spark, sf).groupBy("year").agg(F.percentile("lst", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("q"))
    return q.filter((F.col("q")[0] > F.col("q")[1]) | (F.col("q")[1] > F.col("q")[2])).select("year")


@query("SELECT cell_id FROM cells WHERE cell_id <> row * 25 + col UNION ALL SELECT cell_id FROM cells GROUP BY cell_id HAVING count(*) > 1")
def q_check_cell_id(spark, sf):
    c = cube.cells(spark, sf)
    return c.filter(F.col("cell_id") != F.col("row") * cube.WIDTH + F.col("col")).select("cell_id").unionAll(c.groupBy("cell_id").count().filter("count > 1").select("cell_id"))


@query("""
WITH c AS (SELECT k, list(m ORDER BY i) AS c FROM (SELECT label AS k, i, avg(x) AS m FROM (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL) GROUP BY k),
z AS (SELECT vec_id, any_value(label) AS label, arg_min(k, (list_sum(list_transform(list_zip(embedding, c), lambda z: (z[1]::DOUBLE - z[2]) * (z[1]::DOUBLE - z[2]))), k)) AS zone FROM embeddings, c GROUP BY vec_id)
SELECT label, count(*) AS n, round(avg(CASE WHEN zone = label THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM z GROUP BY label""", cube=False)
def q_check_zone_agreement(spark, sf):
    """Share of rows whose stored zone is their nearest centroid."""
    e = cube.table(spark, sf, "embeddings")
    z = spatial.nearest_centroid(e, spatial.centroids(e, "label", "embedding"), "vec_id", "embedding").join(e.select("vec_id", "label"), "vec_id")
    return z.groupBy("label").agg(F.count(F.lit(1)).alias("n"), R(F.avg(F.when(F.col("zone") == F.col("label"), 1.0).otherwise(0.0)), 6).alias("agreement"))


# File format and streaming -------------------------------------------------------


@query("SELECT cell_id, row, col, round(elev, 2) AS elev FROM cells")
def q_lstb_round_trip(spark, sf):
    """The cell dimension written to the binary container and read back."""
    from ..sources import lstb

    c = cube.cells(spark, sf).select("cell_id", "row", "col", "elev")
    cols = [lstb.Column("cell_id", "i32"), lstb.Column("row", "i32"), lstb.Column("col", "i16"), lstb.Column("elev", "i32", scale=0.01)]
    path = lstb.write(c, cols, kind="cells")
    return lstb.read(spark, path).select(F.col("cell_id").cast("long").alias("cell_id"), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), R(F.col("elev"), 2).alias("elev"))


@query("""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""", cube=False)
def q_stream_windows(spark, sf):
    """Hourly counts by a file stream with a watermark, run to the end of its input."""
    from ..streaming import windows

    return windows.run_to_end(windows.hourly(windows.read_events(spark, sf)), spark)


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, round(arg_max(value, (ts, event_id)), 4) AS value FROM events GROUP BY user_id", cube=False)
def q_keyed_ingestion(spark, sf):
    """The newest event of each user, by a resumable file stream."""
    from ..operators.scratch import new_path
    from ..streaming import ingest, windows

    e, target = windows.read_events(spark, sf), new_path(spark, "ingested")
    spark.createDataFrame([], e.schema).write.parquet(target)
    ingest.ingest(e, ["user_id"], ["ts", "event_id"], target, new_path(spark, "ingest")).awaitTermination()
    return ingest.ingested(spark, e.schema, ["user_id"], ["ts", "event_id"], target).select("user_id", "event_id", R(F.col("value")).alias("value"))


@query("SELECT cell_id, 'Polygon' AS kind, '[[' || col || ',' || row || '],[' || (col + 1) || ',' || row || '],[' || (col + 1) || ',' || (row + 1) || '],[' || col || ',' || (row + 1) || '],[' || col || ',' || row || ']]' AS ring FROM cells")
def q_cell_polygons(spark, sf):
    """Counter-clockwise rings over the shared corner lattice."""
    c = cube.cells(spark, sf)
    x0, y0, x1, y1 = F.col("col"), F.col("row"), F.col("col") + 1, F.col("row") + 1
    ring = F.array(*[F.array(a, b) for a, b in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))])
    return c.select("cell_id", F.lit("Polygon").alias("kind"), F.to_json(ring).alias("ring"))
