"""Calibration, regression, cross-validation, vectors, trees and explanations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import order, regress, scenario, spatial
from ..operators.scratch import stored
from ..sources import cube
from .registry import query

R = S.fixed


def _joined(spark, sf):
    return cube.observations(spark, sf).join(cube.cells(spark, sf), "cell_id")


@query("""
WITH p AS (SELECT regr_slope(lst, elev) AS b, regr_intercept(lst, elev) AS a FROM obs JOIN cells USING (cell_id))
SELECT cls, count(*) AS n, round(CASE WHEN count(*) < 50 THEN (SELECT b FROM p) ELSE regr_slope(lst, elev) END, 6) + 0.0 AS slope,
 round(CASE WHEN count(*) < 50 THEN (SELECT a FROM p) ELSE regr_intercept(lst, elev) END, 3) + 0.0 AS intercept FROM obs JOIN cells USING (cell_id) GROUP BY cls""")
def q_calibration_by_class(spark, sf):
    g = regress.ols_by(_joined(spark, sf), ["cls"], "elev", "lst", 50)
    return g.select("cls", "n", R(F.col("slope"), 6).alias("slope"), R(F.col("intercept"), 3).alias("intercept"))


@query("WITH m AS (SELECT year, avg(lst) AS m FROM obs GROUP BY year) SELECT cell_id, round(avg(lst - m) * count(*) / (count(*) + 3.0), 4) + 0.0 AS shrunk, count(*) AS n FROM obs JOIN m USING (year) GROUP BY cell_id")
def q_shrunk_residual(spark, sf):
    o = stored(cube.observations(spark, sf).select("cell_id", "year", "lst"), "values")
    mean = o.groupBy("year").agg(F.avg("lst").alias("mean"))
    o = o.join(F.broadcast(mean), "year").withColumn("res", F.col("lst") - F.col("mean"))  # one row a frame
    return regress.shrunk_residual(o, "cell_id", "res", 3.0).withColumn("shrunk", R(F.col("shrunk")))


@query("""
WITH f AS (SELECT t.year, regr_slope(lst, elev) AS b, regr_intercept(lst, elev) AS a FROM (SELECT DISTINCT year FROM obs) t, obs o JOIN cells USING (cell_id) WHERE o.year <> t.year GROUP BY t.year)
SELECT o.year, round(sqrt(avg((lst - a - b * elev) ** 2)), 3) AS rmse, round(any_value(b), 6) + 0.0 AS slope FROM obs o JOIN cells USING (cell_id) JOIN f USING (year) GROUP BY o.year""")
def q_loyo_rmse(spark, sf):
    return regress.leave_one_out(_joined(spark, sf), "year", "elev", "lst").select("year", R(F.col("rmse"), 3).alias("rmse"), R(F.col("slope"), 6).alias("slope"))


@query("""
WITH a AS (SELECT scope, count(*) AS n, regr_slope(value, year) AS b, regr_intercept(value, year) AS a, regr_sxx(value, year) AS sxx, regr_syy(value, year) - regr_slope(value, year) * regr_sxy(value, year) AS sse, avg(year) AS mx FROM annual GROUP BY scope HAVING count(*) > 2)
SELECT scope, round(a + b * 2005, 2) AS level, round(2.57 * sqrt(greatest(sse, 0) / (n - 2) * (1 + 1.0 / n + (2005 - mx) ** 2 / sxx)), 2) AS half_width, n FROM a""")
def q_level_ols_pi(spark, sf):
    return regress.prediction_interval(cube.annual(spark, sf), "scope", "year", "value", 2005.0, 2.57).select("scope", R(F.col("level"), 2).alias("level"), R(F.col("half_width"), 2).alias("half_width"), "n")


@query("""
WITH m AS (SELECT cell_id, year, avg(v) FILTER (WHERE flag = 'A') AS a, avg(v) FILTER (WHERE flag = 'N') AS b FROM pixels GROUP BY ALL)
SELECT year, CASE WHEN count(*) >= 20 THEN round(quantile_cont(a - b, 0.5) / 2, 4) + 0.0 END AS "offset", count(*) AS overlap FROM m WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY year""")
def q_path_offset(spark, sf):
    m = cube.pixels(spark, sf).groupBy("cell_id", "year").agg(F.avg(F.when(F.col("flag") == "A", F.col("v"))).alias("a"), F.avg(F.when(F.col("flag") == "N", F.col("v"))).alias("b"))
    return regress.path_offset(m, "year", "a", "b", 20).withColumn("offset", R(F.col("offset")))


@query("""SELECT a, b, round(cov, 4) + 0.0 AS cov FROM (SELECT unnest([{a: 'built', b: 'built', cov: covar_pop(built, built)}, {a: 'built', b: 'elev', cov: covar_pop(built, elev)}, {a: 'built', b: 'lst', cov: covar_pop(built, lst)},
 {a: 'elev', b: 'elev', cov: covar_pop(elev, elev)}, {a: 'elev', b: 'lst', cov: covar_pop(elev, lst)}, {a: 'lst', b: 'lst', cov: covar_pop(lst, lst)}], recursive := true) FROM obs JOIN cells USING (cell_id))""")
def q_coupling_gram(spark, sf):
    return regress.gram(_joined(spark, sf), ["built", "elev", "lst"]).withColumn("cov", R(F.col("cov")))


@query("""
WITH c AS (SELECT year, count(*) AS n, covar_pop(built, built) AS c11, covar_pop(elev, elev) AS c22, covar_pop(built, elev) AS c12, covar_pop(built, lst) AS c1y, covar_pop(elev, lst) AS c2y FROM obs JOIN cells USING (cell_id) GROUP BY year)
SELECT year, n, round((c1y * c22 - c2y * c12) / (c11 * c22 - c12 * c12), 4) + 0.0 AS beta1, round((c2y * c11 - c1y * c12) / (c11 * c22 - c12 * c12), 6) + 0.0 AS beta2 FROM c""")
def q_beta_two_regressor(spark, sf):
    return regress.two_regressors(_joined(spark, sf), ["year"], "lst", "built", "elev").select("year", "n", R(F.col("beta1")).alias("beta1"), R(F.col("beta2"), 6).alias("beta2"))


@query("""
WITH t AS (SELECT scope, regr_slope(value, year) AS b, avg(year) AS my, avg(value) AS mv FROM annual GROUP BY scope)
SELECT a.scope, round(avg(value) FILTER (WHERE year >= 1999) - 0.5 * (avg(value) FILTER (WHERE year >= 1999) - any_value(mv + b * (2001 - my))), 2) AS baseline FROM annual a JOIN t USING (scope) GROUP BY a.scope""")
def q_lbase(spark, sf):
    """Weather-normalised baseline: recent level less half its departure from the trend."""
    g = cube.annual(spark, sf).groupBy("scope").agg(F.avg(F.when(F.col("year") >= 1999, F.col("value"))).alias("recent"), (F.avg("value") + F.regr_slope("value", "year") * (2001 - F.avg("year"))).alias("trend"))
    return g.select("scope", R(F.col("recent") - 0.5 * (F.col("recent") - F.col("trend")), 2).alias("baseline"))


@query("SELECT cell_id, year, round(elev - avg(elev) FILTER (WHERE cell_id % 3 = 0) OVER (PARTITION BY year), 4) + 0.0 AS recentred FROM obs JOIN cells USING (cell_id)")
def q_oof_recentred(spark, sf):
    """Predictions less their mean over a frame's fixed cells."""
    j = stored(_joined(spark, sf).select("cell_id", "year", "elev"), "predictions")
    mean = j.filter("cell_id % 3 = 0").groupBy("year").agg(F.avg("elev").alias("mean"))
    return j.join(F.broadcast(mean), "year", "left").select("cell_id", "year", R(F.col("elev") - F.col("mean")).alias("recentred"))  # one row a frame


@query("""
WITH r AS (SELECT cell_id, year, w, lst - elev AS rho FROM obs JOIN cells USING (cell_id)), s AS (SELECT *, sum(w) OVER c AS sw, sum(w * rho) OVER c AS swr FROM r WINDOW c AS (PARTITION BY cell_id)),
l AS (SELECT lam, s.*, (swr - w * rho) / (sw - w + lam) AS est FROM s, (VALUES (1.0::DOUBLE), (10.0::DOUBLE), (100.0::DOUBLE)) g(lam))
SELECT lam, round(sqrt(sum(w * (rho - est) ** 2) / sum(w)), 4) AS rmse FROM l GROUP BY lam""")
def q_persistent_residual_lambda(spark, sf):
    """Leave-one-frame-out error of a shrunk persistent residual, by shrinkage."""
    c = Window.partitionBy("cell_id")
    r = _joined(spark, sf).withColumn("rho", F.col("lst") - F.col("elev"))
    r = r.withColumn("sw", F.sum("w").over(c)).withColumn("swr", F.sum(F.col("w") * F.col("rho")).over(c))
    r = r.withColumn("lam", F.explode(F.array(F.lit(1.0), F.lit(10.0), F.lit(100.0))))
    est = (F.col("swr") - F.col("w") * F.col("rho")) / (F.col("sw") - F.col("w") + F.col("lam"))
    return r.groupBy("lam").agg(R(F.sqrt(F.sum(F.col("w") * F.pow(F.col("rho") - est, 2)) / F.sum("w"))).alias("rmse"))


_CENTRES = """c AS (SELECT k, list(m ORDER BY i) AS c FROM (SELECT label AS k, i, avg(x) AS m FROM (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL) GROUP BY k)"""


@query(f"""
WITH {_CENTRES}, d AS (SELECT vec_id, k, list_sum(list_transform(list_zip(embedding, c), lambda z: (z[1]::DOUBLE - z[2]) * (z[1]::DOUBLE - z[2]))) AS d2 FROM embeddings, c)
SELECT vec_id, arg_min(k, (d2, k)) AS zone, round(sqrt(min(d2)), 5) AS distance FROM d GROUP BY vec_id""", cube=False)
def q_nearest_centroid(spark, sf):
    e = cube.table(spark, sf, "embeddings")
    return spatial.nearest_centroid(e, spatial.centroids(e, "label", "embedding"), "vec_id", "embedding").select("vec_id", "zone", R(F.col("distance"), 5).alias("distance"))


@query(f"""
WITH {_CENTRES}, d AS (SELECT vec_id, embedding, k, list_sum(list_transform(list_zip(embedding, c), lambda z: (z[1]::DOUBLE - z[2]) * (z[1]::DOUBLE - z[2]))) AS d2 FROM embeddings, c),
n AS (SELECT vec_id, sqrt(min(d2)) AS di FROM d GROUP BY vec_id), q AS (SELECT quantile_cont(di, 0.75) + 1.5 * (quantile_cont(di, 0.75) - quantile_cont(di, 0.25)) AS t FROM n)
SELECT count(*) FILTER (WHERE di > t) AS outside, round(any_value(t), 4) AS threshold, count(*) AS n FROM n, q""", cube=False)
def q_di_threshold(spark, sf):
    """Area of applicability: distances beyond Q75 + 1.5 IQR."""
    e = cube.table(spark, sf, "embeddings")
    d = spatial.nearest_centroid(e, spatial.centroids(e, "label", "embedding"), "vec_id", "embedding")
    q = order.quantiles(d, [], F.col("distance"), [0.25, 0.75]).select(F.col("q")[1] + 1.5 * (F.col("q")[1] - F.col("q")[0]))
    return d.agg(F.count_if(F.col("distance") > q.scalar()).alias("outside"), F.count(F.lit(1)).alias("n")).select("outside", R(q.scalar()).alias("threshold"), "n")


@query("""
WITH t AS (SELECT len(list_filter([0.2, 0.4, 0.6, 0.8], lambda e: e <= built)) AS decile, lst - elev AS res, w FROM obs JOIN cells USING (cell_id))
SELECT decile::INTEGER AS decile, round(sqrt(sum(w * res * res) / sum(w)), 4) AS rmse, round(quantile_cont(abs(res), 0.9), 4) AS q90, count(*) AS n FROM t GROUP BY 1 HAVING count(*) >= 5""")
def q_decile_error_model(spark, sf):
    d = _joined(spark, sf).withColumn("res", F.col("lst") - F.col("elev"))
    return regress.decile_errors(d, [0.2, 0.4, 0.6, 0.8], "built", "res", "w", 5).select("decile", R(F.col("rmse")).alias("rmse"), R(F.col("q90")).alias("q90"), "n")


@query("""
SELECT label, n, row_number() OVER (ORDER BY m DESC, label) - 1 AS zone FROM (SELECT label, count(*) AS n, round(avg(embedding[1]::DOUBLE), 6) AS m FROM embeddings GROUP BY label)""", cube=False)
def q_label_clusters(spark, sf):
    """Canonical zone order by a cluster mean (a few rows)."""
    g = cube.table(spark, sf, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), R(F.avg(F.col("embedding")[0].cast("double")), 6).alias("m"))
    return g.select("label", "n", (F.row_number().over(Window.orderBy(F.col("m").desc(), "label")) - 1).cast("long").alias("zone"))


def _kmeans(spark, sf, k=4):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    e = cube.table(spark, sf, "embeddings").select("vec_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    return KMeans(k=k, seed=5, maxIter=20).fit(e).transform(e)


@query()
def q_kmeans(spark, sf):
    return _kmeans(spark, sf).groupBy(F.col("prediction").alias("cluster")).agg(F.count(F.lit(1)).alias("n"))


@query()
def q_silhouette(spark, sf):
    from pyspark.ml.evaluation import ClusteringEvaluator

    s = ClusteringEvaluator().evaluate(_kmeans(spark, sf))
    return spark.createDataFrame([(4, round(s, 6))], "k int, silhouette double")


@query()
def q_fit_regressors(spark, sf):
    """Out-of-fold RMSE of a weighted ridge and of gradient-boosted trees over spatial folds."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression

    d = _joined(spark, sf).withColumn("fold", (F.col("district") % 2).cast("int")).withColumn("label", F.col("lst"))
    d = VectorAssembler(inputCols=["built", "elev", "row", "col"], outputCol="features").transform(d).select("cell_id", "fold", "features", "label", "w").cache()
    out = []
    for name, m in (("ridge", LinearRegression(regParam=0.1, elasticNetParam=0.0, weightCol="w", maxIter=20)), ("gbt", GBTRegressor(maxIter=5, maxDepth=3, seed=1, weightCol="w"))):
        for fold in (0, 1):
            p = m.fit(d.filter(F.col("fold") != fold)).transform(d.filter(F.col("fold") == fold))
            out.append((name, fold, p.agg(F.sqrt(F.sum(F.col("w") * F.pow(F.col("prediction") - F.col("label"), 2)) / F.sum("w"))).first()[0]))
    d.unpersist()
    return spark.createDataFrame(out, "model string, fold int, rmse double")


#: A small compact model: features are built, elev / 1000 and row / 80.
TREES = [
    {"feature": 0, "threshold": 0.5, "left": {"feature": 1, "threshold": 1.2, "left": {"leaf": -0.4}, "right": {"leaf": 0.1}}, "right": {"leaf": 0.7}},
    {"feature": 1, "threshold": 1.5, "default_left": False, "left": {"leaf": -0.2}, "right": {"feature": 2, "threshold": 0.5, "left": {"leaf": 0.3}, "right": {"leaf": 0.9}}},
]
BASE = 30.0


def _features():
    return [F.when(F.col("cell_id") % 7 != 0, F.col("built")), F.when(F.col("cell_id") % 11 != 0, F.col("elev") / 1000), F.col("row") / 80]


@query("""
WITH f AS (SELECT cell_id, CASE WHEN cell_id % 7 <> 0 THEN built END AS a, CASE WHEN cell_id % 11 <> 0 THEN elev / 1000 END AS b, row / 80 AS c FROM cells)
SELECT cell_id, round(30.0 + CASE WHEN a IS NULL OR a < 0.5 THEN CASE WHEN b IS NULL OR b < 1.2 THEN -0.4 ELSE 0.1 END ELSE 0.7 END
 + CASE WHEN b < 1.5 THEN -0.2 WHEN c < 0.5 THEN 0.3 ELSE 0.9 END, 4)::DOUBLE AS pred FROM f""")
def q_tree_eval(spark, sf):
    return cube.cells(spark, sf).select("cell_id", R(scenario.ensemble(TREES, BASE, _features())).alias("pred"))


@query()
def q_group_shap_additivity(spark, sf):
    """Exact group contributions; base + their sum is the prediction."""
    values = scenario.interventional_shap(TREES, BASE, [0, 1, 1], [0.4, 1.3, 0.2])

    def run(batches):
        for b in batches:
            x = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (1, 2, 3)], axis=1) if b.num_rows else np.empty((0, 3))
            phi, pred = values(x)
            base = pred - phi.sum(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(phi[:, k]) for k in (0, 1)], pa.array(base), pa.array(pred)], names=["cell_id", "shap_0", "shap_1", "base", "pred"])

    a, b, c = _features()
    d = cube.cells(spark, sf).select("cell_id", a.alias("a"), b.alias("b"), c.cast("double").alias("c"))
    return d.mapInArrow(run, "cell_id long, shap_0 double, shap_1 double, base double, pred double")


@query("""
WITH q AS (SELECT quantile_cont(built, [0.2, 0.4, 0.6, 0.8]) AS e FROM cells), t AS (SELECT len(list_filter(e, lambda x: x <= built)) AS bin, built, lst FROM obs JOIN cells USING (cell_id), q)
SELECT bin::INTEGER AS bin, round(avg(built), 5) AS x, round(avg(lst), 4) AS y, count(*) AS n FROM t GROUP BY 1""")
def q_binned_curve(spark, sf):
    """Dependence curve over quantile bins."""
    e = order.quantiles(cube.cells(spark, sf), [], F.col("built"), [0.2, 0.4, 0.6, 0.8]).select("q")
    k = F.size(F.filter("edges", lambda x: x <= F.col("built")))
    return _joined(spark, sf).withColumn("edges", e.scalar()).groupBy(k.alias("bin")).agg(R(F.avg("built"), 5).alias("x"), R(F.avg("lst")).alias("y"), F.count(F.lit(1)).alias("n"))


@query("""
WITH d AS (SELECT knot, w, built AS x, greatest(0, built - knot) AS h, lst AS y FROM obs JOIN cells USING (cell_id), (VALUES (0.2::DOUBLE), (0.35::DOUBLE), (0.5::DOUBLE), (0.65::DOUBLE), (0.8::DOUBLE)) k(knot)),
m AS (SELECT knot, sum(w) AS sw, sum(w*x)/sum(w) AS mx, sum(w*h)/sum(w) AS mh, sum(w*y)/sum(w) AS my, sum(w*x*x)/sum(w) AS xx, sum(w*h*h)/sum(w) AS hh, sum(w*x*h)/sum(w) AS xh, sum(w*x*y)/sum(w) AS xy, sum(w*h*y)/sum(w) AS hy FROM d GROUP BY knot),
c AS (SELECT knot, xx-mx*mx AS xx, hh-mh*mh AS hh, xh-mx*mh AS xh, xy-mx*my AS xy, hy-mh*my AS hy FROM m)
SELECT knot, round((xy*hh-hy*xh)/(xx*hh-xh*xh), 2) + 0.0 AS slope, round((hy*xx-xy*xh)/(xx*hh-xh*xh), 2) + 0.0 AS bend FROM c""")
def q_hinge_sse(spark, sf):
    return regress.hinge(_joined(spark, sf), [0.2, 0.35, 0.5, 0.65, 0.8], "built", "lst", "w").select("knot", R(F.col("slope"), 2).alias("slope"), R(F.col("bend"), 2).alias("bend"))


@query("""
WITH r AS (SELECT (built >= 0.5)::INT AS y, rank() OVER (ORDER BY elev) + (count(*) OVER (PARTITION BY elev) - 1) / 2.0 AS r FROM cells)
SELECT round((sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6) AS auc, sum(y)::BIGINT AS n_positive, sum(1 - y)::BIGINT AS n_negative FROM r""")
def q_auc(spark, sf):
    d = cube.cells(spark, sf).withColumn("y", (F.col("built") >= 0.5).cast("int"))
    return regress.auc(d, "elev", "y").select(R(F.col("auc"), 6).alias("auc"), "n_positive", "n_negative")
