"""Points in polygons and the footprint of a what-if."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import polygons, scenario, tiles, whatif
from ..operators.scratch import stored
from ..sources import cube
from .registry import query

R = S.fixed

#: Corners of a nation's outline and of its hole around the nation's centre, as (x, y).
OUTER, HOLE = [(0, -7), (2, -3), (4, -3), (3, 0), (4, 5), (1, 4), (0, 7), (-2, 3), (-3, 3), (-2, 0), (-3, -5)], [(-1, -1), (1, -1), (1, 1), (-1, 1)]


def _corners(ring):
    return "[" + ", ".join(f"{{x: 5 * (n_nationkey % 5) + 2 + {x}, y: 16 * (n_nationkey // 5) + 8 + {y}}}" for x, y in ring) + "]"


_OUTLINES = f"""r AS (SELECT n_nationkey AS k, {_corners(OUTER)} AS ring FROM nation UNION ALL SELECT n_nationkey, {_corners(HOLE)} FROM nation WHERE n_nationkey % 2 = 0),
e AS (SELECT k, ring[i].x::DOUBLE AS x1, ring[i].y::DOUBLE AS y1, ring[i % len(ring) + 1].x::DOUBLE AS x2, ring[i % len(ring) + 1].y::DOUBLE AS y2 FROM (SELECT k, ring, unnest(range(1, len(ring) + 1)) AS i FROM r)),
s AS (SELECT cell_id, k, *, (x2 - x1) * (row - y1) - (y2 - y1) * (col - x1) AS side FROM cells, e),
h AS (SELECT cell_id, k AS polygon FROM s GROUP BY cell_id, k HAVING bool_or(side = 0 AND col BETWEEN least(x1, x2) AND greatest(x1, x2) AND row BETWEEN least(y1, y2) AND greatest(y1, y2))
  OR count(*) FILTER (WHERE (y1 > row) <> (y2 > row) AND col < (x2 - x1) * (row - y1) / (y2 - y1) + x1) % 2 = 1)"""


def _rings(spark, sf):
    n = cube.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("polygon"))
    x, y = 5 * (F.col("polygon") % 5) + 2, 16 * F.floor(F.col("polygon") / 5) + 8
    ring = lambda corners: F.array(*[F.struct((x + a).cast("double").alias("x"), (y + b).cast("double").alias("y")) for a, b in corners])
    return n.select("polygon", ring(OUTER).alias("ring")).unionByName(n.filter("polygon % 2 = 0").select("polygon", ring(HOLE).alias("ring")))


@query(f"WITH {_OUTLINES} SELECT cell_id, polygon::BIGINT AS polygon FROM h")
def q_point_in_polygon(spark, sf):
    """Cells in the outlines of nations, with holes, and cells on edges and corners."""
    p = cube.cells(spark, sf).select("cell_id", F.col("col").alias("x"), F.col("row").alias("y"))
    return polygons.containing(p, _rings(spark, sf), "cell_id", 4.0)


@query(f"""
WITH {_OUTLINES}, t AS (SELECT cell_id, substr(n_name, 1 + (cell_id % 3)::INT) AS name FROM cells JOIN nation ON n_nationkey = district),
n AS (SELECT cell_id, arg_min(n_nationkey, (levenshtein(name, n_name), n_nationkey)) AS k FROM t, nation WHERE levenshtein(name, n_name) <= 2 GROUP BY cell_id), i AS (SELECT cell_id, min(polygon) AS k FROM h GROUP BY cell_id)
SELECT c.cell_id, coalesce(i.k, n.k)::BIGINT AS polygon, CASE WHEN i.k IS NOT NULL THEN 'place' WHEN n.k IS NOT NULL THEN 'name' END AS how FROM cells c LEFT JOIN i USING (cell_id) LEFT JOIN n USING (cell_id)""")
def q_match_places(spark, sf):
    """The nation that holds a cell, else the one whose name is nearest to a damaged one."""
    n = cube.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("district"), "n_name")
    p = cube.cells(spark, sf).join(F.broadcast(n), "district").select("cell_id", F.col("col").alias("x"), F.col("row").alias("y"), F.expr("substr(n_name, 1 + int(cell_id % 3))").alias("name"))
    names = [(r["district"], r["n_name"]) for r in n.orderBy("district").collect()]  # 25 nations
    return polygons.matched(p, _rings(spark, sf), "cell_id", "name", names, 4.0)


WINDOWS = (3, 7)
TREE = {"feature": 1, "threshold": 0.5513, "left": {"feature": 0, "threshold": 0.3007, "left": {"leaf": -0.6}, "right": {"leaf": 0.2}}, "right": {"feature": 2, "threshold": 0.5007, "left": {"leaf": 0.5}, "right": {"leaf": 1.1}}}


def _whatif(spark, sf):
    """Features with focal means, and the edit: district 3 is built up."""
    c = cube.cells(spark, sf).select("cell_id", "row", "col", "district", F.when(F.col("cell_id") % 13 != 0, F.col("built")).alias("built"))
    f = c
    for w in WINDOWS:
        f = f.join(tiles.box_stats(c, "built", w).select("row", "col", F.col("mean").alias(f"built_m{w}")), ["row", "col"])
    f = stored(f, "features")
    stays = F.col("built").isNotNull() & (F.col("row") % 4 != 3)  # some cells become missing
    edits = f.filter("district = 3").select("row", "col", F.when(stays, F.least(F.lit(1.0), F.col("built") + 0.2)).alias("built"))
    return f, edits


_PREDICT = "CASE WHEN b3 IS NULL OR b3 < 0.5513 THEN CASE WHEN b IS NULL OR b < 0.3007 THEN -0.6 ELSE 0.2 END WHEN b7 IS NULL OR b7 < 0.5007 THEN 0.5 ELSE 1.1 END"
_BOTH = f"""
WITH c AS (SELECT cell_id, row, col, district = 3 AS zone, CASE WHEN cell_id % 13 <> 0 THEN built END AS a FROM cells),
n AS (SELECT *, CASE WHEN NOT zone THEN a WHEN row % 4 <> 3 THEN CASE WHEN a IS NOT NULL THEN least(1.0, a + 0.2) END END AS b FROM c),
m AS (SELECT p.cell_id, any_value(p.zone) AS zone, any_value(p.a) AS a, any_value(p.b) AS b, {", ".join(f"avg(q.{v}) FILTER (WHERE abs(p.row - q.row) <= {w // 2} AND abs(p.col - q.col) <= {w // 2}) AS {v}{w}, bool_or(q.a IS DISTINCT FROM q.b) FILTER (WHERE abs(p.row - q.row) <= {w // 2} AND abs(p.col - q.col) <= {w // 2}) AS r{v}{w}" for v in "ab" for w in WINDOWS)}
  FROM n p JOIN n q ON abs(p.row - q.row) <= 3 AND abs(p.col - q.col) <= 3 GROUP BY p.cell_id),
k AS (SELECT cell_id, zone, a, b, a3, a7, CASE WHEN ra3 THEN b3 ELSE a3 END AS b3, CASE WHEN ra7 THEN b7 ELSE a7 END AS b7 FROM m),
f AS (SELECT *, {" OR ".join(f"coalesce(abs(b{w} - a{w}) > 1e-6 * greatest(1.0, abs(a{w})), (a{w} IS NULL) <> (b{w} IS NULL))" for w in ("", 3, 7))} AS material, zone AND ({" OR ".join(f"a{w} IS DISTINCT FROM b{w}" for w in ("", 3, 7))}) AS touched FROM k),
d AS (SELECT *, ({_PREDICT})::DOUBLE AS q, ({_PREDICT.replace("b3", "a3").replace("b7", "a7").replace("b IS", "a IS").replace("b <", "a <")})::DOUBLE AS p FROM f)"""


@query(f"{_BOTH} SELECT cell_id, round(b, 6) AS built, round(b3, 6) AS built_m3, round(b7, 6) AS built_m7, NOT zone AS spill FROM d WHERE material OR touched")
def q_whatif_footprint(spark, sf):
    """Cells that a what-if changes, in its zone and around it; equal to recomputing the whole map."""
    f, edits = _whatif(spark, sf)
    out = whatif.footprint(f, edits, "built", WINDOWS, tile=16).join(f.select("row", "col", "cell_id"), ["row", "col"])
    return out.select("cell_id", *[R(F.col(n), 6).alias(n) for n in ("built", "built_m3", "built_m7")], "spill")


@query(f"{_BOTH} SELECT round(coalesce(sum(q - p) FILTER (WHERE zone), 0) / count(*) FILTER (WHERE zone), 6) + 0.0 AS zone_mean, count(*) FILTER (WHERE zone) AS n_zone, round(avg(q - p) FILTER (WHERE NOT zone AND material), 6) + 0.0 AS spill_mean, count(*) FILTER (WHERE NOT zone AND material) AS n_spill FROM d")
def q_whatif_effect(spark, sf):
    """Mean change of the prediction in the zone and in what it spills over to."""
    f, edits = _whatif(spark, sf)
    model = scenario.ensemble([TREE], 0.0, [F.col(n) for n in ("built", "built_m3", "built_m7")])
    out = whatif.zone_effect(f, whatif.footprint(f, edits, "built", WINDOWS, tile=16), edits, model, model)
    return out.select(R(F.col("zone_mean"), 6).alias("zone_mean"), "n_zone", R(F.col("spill_mean"), 6).alias("spill_mean"), "n_spill")
