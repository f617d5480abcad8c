"""Area of applicability and explanations of tree models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import neighbours, order, scenario, treeshap
from ..operators.scratch import stored
from ..sources import cube
from .models import BASE, TREES, _features
from .registry import query

R = S.fixed


@query("""
WITH e AS (SELECT vec_id, vec_id % 5 AS fold, list_transform(embedding, lambda x, i: x::DOUBLE * (1 + (i - 1) % 3)) AS v FROM embeddings),
d AS (SELECT a.vec_id, b.vec_id AS neighbour, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.fold <> b.fold)
SELECT vec_id, arg_min(neighbour, (d, neighbour)) AS neighbour, round(min(d), 6) AS distance FROM d GROUP BY vec_id""")
def q_nearest_other_fold(spark, sf):
    """Nearest row of another fold, features weighted."""
    e = cube.table(spark, sf, "embeddings").withColumn("fold", F.col("vec_id") % 5)
    e = e.withColumn("v", F.transform("embedding", lambda x, i: x.cast("double") * (1 + i % 3)))
    return neighbours.nearest_of_other_group(e, "vec_id", "fold", "v").select("vec_id", "neighbour", R(F.col("distance"), 6).alias("distance"))


_CELL_SPACE = "WITH f AS (SELECT cell_id, district % 5 AS fold, [3 * built, elev / 1000, 2 * row / 80] AS v FROM cells)"


@query(f"""
{_CELL_SPACE},
d AS (SELECT a.cell_id, a.fold, min(list_distance(a.v, b.v)) AS d FROM f a JOIN f b ON a.fold <> b.fold GROUP BY ALL),
q AS (SELECT quantile_cont(d, 0.75) + 1.5 * (quantile_cont(d, 0.75) - quantile_cont(d, 0.25)) AS t FROM d)
SELECT fold, count(*) AS n, round(avg(d), 6) AS mean_distance, round(max(d), 6) AS most, count(*) FILTER (WHERE d > t) AS outside FROM d, q GROUP BY fold""")
def q_applicability_by_fold(spark, sf):
    """How far a fold's cells lie from the training rows of the others, and how many lie outside the area of applicability."""
    c = cube.cells(spark, sf).withColumn("fold", F.col("district") % 5)
    c = c.withColumn("v", neighbours.weighted(F.array(F.col("built"), F.col("elev") / 1000, F.col("row") / 80), F.array(F.lit(3.0), F.lit(1.0), F.lit(2.0))))
    d = stored(neighbours.nearest_of_other_group(c, "cell_id", "fold", "v").join(c.select("cell_id", "fold"), "cell_id"), "distances")
    q = order.quantiles(d, [], F.col("distance"), [0.25, 0.75]).select(F.col("q")[1] + 1.5 * (F.col("q")[1] - F.col("q")[0]))
    return d.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), R(F.avg("distance"), 6).alias("mean_distance"), R(F.max("distance"), 6).alias("most"), F.count_if(F.col("distance") > q.scalar()).alias("outside"))


#: Subset sums of the two trees: what each expects when only some of its two features are known.
_SUBSETS = """
WITH f AS (SELECT cell_id, cls, CASE WHEN cell_id % 7 <> 0 THEN built END AS a, CASE WHEN cell_id % 11 <> 0 THEN elev / 1000 END AS b, row / 80 AS c FROM cells),
g AS (SELECT *, coalesce(a < 0.5, true)::INT AS p, coalesce(b < 1.2, true)::INT AS q, coalesce(b < 1.5, false)::INT AS r, (c < 0.5)::INT AS s FROM f),
z AS (SELECT avg(p) AS p, avg(q) FILTER (WHERE p = 1) AS q, avg(r) AS r, avg(s) FILTER (WHERE r = 0) AS s FROM g),
t AS (SELECT cell_id, cls,
  z.p * (z.q * -0.4 + (1 - z.q) * 0.1) + (1 - z.p) * 0.7 AS n1, g.p * (z.q * -0.4 + (1 - z.q) * 0.1) + (1 - g.p) * 0.7 AS a1,
  z.p * (g.q * -0.4 + (1 - g.q) * 0.1) + (1 - z.p) * 0.7 AS b1, g.p * (g.q * -0.4 + (1 - g.q) * 0.1) + (1 - g.p) * 0.7 AS ab1,
  z.r * -0.2 + (1 - z.r) * (z.s * 0.3 + (1 - z.s) * 0.9) AS n2, g.r * -0.2 + (1 - g.r) * (z.s * 0.3 + (1 - z.s) * 0.9) AS b2,
  z.r * -0.2 + (1 - z.r) * (g.s * 0.3 + (1 - g.s) * 0.9) AS c2, g.r * -0.2 + (1 - g.r) * (g.s * 0.3 + (1 - g.s) * 0.9) AS bc2 FROM g, z)"""


def _explainer(c):
    return treeshap.Explainer(TREES, treeshap.leaf_counts(c, TREES, _features()), BASE, [0, 1, 2])


@query(f"""{_SUBSETS}
SELECT cell_id, round((a1 - n1 + ab1 - b1) / 2, 6) + 0.0 AS shap_0, round((b1 - n1 + ab1 - a1 + b2 - n2 + bc2 - c2) / 2, 6) + 0.0 AS shap_1,
 round((c2 - n2 + bc2 - b2) / 2, 6) + 0.0 AS shap_2, round(30 + n1 + n2, 6) AS expected FROM t""")
def q_tree_shap(spark, sf):
    """Shapley values by paths, checked against every row's prediction."""
    c = cube.cells(spark, sf)
    out = treeshap.explain(c, _explainer(c), ["cell_id"], _features(), predicted=scenario.ensemble(TREES, BASE, _features()))
    return out.select("cell_id", *[R(F.col(n), 6).alias(n) for n in ("shap_0", "shap_1", "shap_2", "expected")])


@query(f"""{_SUBSETS},
p AS (SELECT cls, (ab1 - a1 - b1 + n1) / 2 AS ab, (bc2 - b2 - c2 + n2) / 2 AS bc, a1 - n1 + ab1 - b1 AS a, b1 - n1 + ab1 - a1 + b2 - n2 + bc2 - c2 AS b, c2 - n2 + bc2 - b2 AS c FROM t),
m AS (SELECT cls, unnest([{{g: 0, h: 0, x: a / 2 - ab}}, {{g: 1, h: 1, x: b / 2 - ab - bc}}, {{g: 2, h: 2, x: c / 2 - bc}}, {{g: 0, h: 1, x: ab}}, {{g: 1, h: 0, x: ab}},
  {{g: 1, h: 2, x: bc}}, {{g: 2, h: 1, x: bc}}, {{g: 0, h: 2, x: 0}}, {{g: 2, h: 0, x: 0}}], recursive := true) FROM p)
SELECT cls, g::BIGINT AS g, h::BIGINT AS h, round(avg(abs(x)), 6) + 0.0 AS mean_abs, count(*) AS n FROM m GROUP BY ALL""")
def q_tree_interactions(spark, sf):
    c = cube.cells(spark, sf)
    return treeshap.mean_interactions(c, _explainer(c), "cls", _features()).withColumn("mean_abs", R(F.col("mean_abs"), 6))


@query("""
WITH x AS (SELECT CASE WHEN built <= 0.3 THEN 0.0::DOUBLE WHEN built > 0.8 THEN 1.0::DOUBLE ELSE built END AS x, lst FROM obs JOIN cells USING (cell_id)),
a AS (SELECT x FROM x GROUP BY x HAVING count(*) * 8 >= (SELECT count(*) FROM x)), k AS (SELECT greatest(1, 8 - count(*)) AS k FROM a),
c AS (SELECT unnest(quantile_cont(x, [0, 1 / 6.0, 2 / 6.0, 3 / 6.0, 4 / 6.0, 5 / 6.0, 1])) AS e FROM x WHERE x NOT IN (SELECT x FROM a) AND (SELECT k FROM k) = 6),
e AS (SELECT DISTINCT e FROM (SELECT e FROM c UNION ALL SELECT x FROM a UNION ALL SELECT nextafter(x, 1e300::DOUBLE) FROM a UNION ALL SELECT min(x) FROM x UNION ALL SELECT max(x) FROM x)),
s AS (SELECT e, lead(e) OVER (ORDER BY e) AS z, max(e) OVER () AS top FROM e), b AS (SELECT e, count(*) AS n, avg(lst) AS y FROM s JOIN x ON x.x >= s.e AND (x.x < s.z OR (s.z = s.top AND x.x = s.top)) GROUP BY e),
w AS (SELECT *, row_number() OVER (ORDER BY e) AS i, e IN (SELECT x FROM a) AS atom FROM b),
j AS (SELECT least(p.i, q.i) AS spot FROM w p JOIN w q ON abs(p.i - q.i) = 1 AND NOT p.atom AND NOT q.atom WHERE (SELECT count(*) FROM w) = 9 ORDER BY p.n, p.i, q.n, q.i LIMIT 1),
m AS (SELECT i - (i > coalesce((SELECT spot FROM j), 99))::INT AS i, min(e) AS e, sum(n)::BIGINT AS n, sum(n * y) / sum(n) AS y FROM w GROUP BY 1)
SELECT i - 1 AS bin, round(e, 6) AS low, n, round(y, 4) AS mean FROM m""")
def q_atom_aware_bins(spark, sf):
    """Curve over quantile bins in which values that many rows share are bins of their own."""
    j = cube.observations(spark, sf).join(cube.cells(spark, sf), "cell_id")
    x = F.when(F.col("built") <= 0.3, 0.0).when(F.col("built") > 0.8, 1.0).otherwise(F.col("built"))
    d = stored(j.select(x.alias("x"), "lst"), "atoms")
    edges = order.atom_edges(d, F.col("x"), 8)
    b = d.groupBy(order.bin_of(F.col("x"), edges).alias("bin")).agg(F.count(F.lit(1)).alias("n"), R(F.avg("lst")).alias("mean"))
    low = F.element_at(F.array(*[F.lit(e) for e in edges]), F.col("bin") + 1)
    return b.select(F.col("bin").cast("long").alias("bin"), R(low, 6).alias("low"), "n", "mean")
