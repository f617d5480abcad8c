"""Neighbourhoods, distances, landscape metrics and spatial statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import grid, moran, spatial, tiles
from ..sources import cube
from .registry import query

R = S.fixed


def _lattice(spark, sf):
    """The dense lattice; cells beyond the last one are null."""
    c = cube.cells(spark, sf).drop("district")
    return grid.dense(c).join(c.hint("merge"), ["row", "col"], "left")  # never all cells in the driver


def _boxes(spark, sf, size):
    """Cells with the statistics of their box, by tiles."""
    c = cube.cells(spark, sf)
    return tiles.box_stats(c, "elev", size).join(c, ["row", "col"])


def _box(size: int, value: str) -> str:
    h = size // 2
    return f"""SELECT a.cell_id, round({value}, 4) + 0.0 AS v FROM cells a JOIN cells b ON abs(a.row - b.row) <= {h} AND abs(a.col - b.col) <= {h} GROUP BY a.cell_id, a.elev"""


@query(_box(3, "avg(b.elev)"))
def q_box_mean_3(spark, sf):
    return _boxes(spark, sf, 3).select("cell_id", R(F.col("mean")).alias("v"))


@query(_box(15, "avg(b.elev)"))
def q_box_mean_15(spark, sf):
    return _boxes(spark, sf, 15).select("cell_id", R(F.col("mean")).alias("v"))


@query(_box(7, "stddev_pop(b.elev)"))
def q_box_std_7(spark, sf):
    return _boxes(spark, sf, 7).select("cell_id", R(F.col("std")).alias("v"))


@query(_box(7, "a.elev - avg(b.elev)"))
def q_tpi_7(spark, sf):
    return _boxes(spark, sf, 7).select("cell_id", R(F.col("elev") - F.col("mean")).alias("v"))


@query("""SELECT a.cell_id, round(sqrt(min((a.row - b.row) ** 2 + (a.col - b.col) ** 2)), 6) AS km FROM cells a, cells b WHERE b.built >= 0.98 GROUP BY a.cell_id""")
def q_edt(spark, sf):
    d = grid.distance(_lattice(spark, sf), F.col("built") >= 0.98)
    return d.filter("cell_id is not null and distance is not null").select("cell_id", R(F.col("distance"), 6).alias("km"))


@query("""
WITH p AS (SELECT a.cls AS a, b.cls AS b FROM cells a JOIN cells b ON (a.row = b.row AND b.col = a.col + 1) OR (a.col = b.col AND b.row = a.row + 1)),
n AS (SELECT a, b, count(*) AS n FROM (SELECT a, b FROM p UNION ALL SELECT b, a FROM p) GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER () AS q FROM n)
SELECT round(100 * (1 + sum(q * ln(q)) / (2 * ln(6.0))), 6) AS contagion, sum(n)::BIGINT AS pairs FROM s""")
def q_adjacency_contagion(spark, sf):
    """The adjacency matrix has a few classes squared rows, so its totals are one small task."""
    adj = grid.adjacency(_lattice(spark, sf), "cls")
    return grid.contagion(adj, 6).select(R(F.col("contagion"), 6).alias("contagion"), "pairs")


@query("SELECT cell_id, row // 5 * 5 + col // 5 AS block5, row // 10 * 3 + col // 10 AS block10 FROM cells")
def q_block_ids(spark, sf):
    return cube.cells(spark, sf).select("cell_id", grid.block_id(5, cube.WIDTH).alias("block5"), grid.block_id(10, cube.WIDTH).alias("block10"))


@query()
def q_greedy_folds(spark, sf):
    """Blocks dealt to five folds; block counts are the only thing the driver sees."""
    o = cube.observations(spark, sf).join(cube.cells(spark, sf), "cell_id").withColumn("block", grid.block_id(5, cube.WIDTH))
    counts = [(r["block"], r["n"]) for r in o.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()]
    folds = grid.greedy_folds(counts, 5)
    return spark.createDataFrame([(b, folds[b], n) for b, n in sorted(counts)], "block long, fold int, n long")


@query("""
WITH pt AS (SELECT cell_id AS point_id, row * 0.7 + 0.3 AS y, col * 0.9 + 0.2 AS x FROM cells),
m AS (SELECT p.point_id, (1 - abs(p.y - c.row)) * (1 - abs(p.x - c.col)) AS w, c.elev FROM pt p JOIN cells c ON c.row - floor(p.y) IN (0, 1) AND c.col - floor(p.x) IN (0, 1))
SELECT point_id, round(sum(w * elev) / sum(w), 4) AS elev FROM m GROUP BY point_id""")
def q_bilinear(spark, sf):
    c = cube.cells(spark, sf)
    p = c.select(F.col("cell_id").alias("point_id"), (F.col("row") * 0.7 + 0.3).alias("y"), (F.col("col") * 0.9 + 0.2).alias("x"))
    return grid.bilinear(p, c, "elev").select("point_id", R(F.col("elev")).alias("elev"))


@query("""
WITH m AS (SELECT avg(elev) AS mean FROM cells), z AS (SELECT cell_id, row, col, elev - (SELECT mean FROM m) AS z FROM cells),
l AS (SELECT a.cell_id, max(a.z) * avg(b.z) AS c FROM z a JOIN z b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND a.cell_id <> b.cell_id GROUP BY a.cell_id)
SELECT round((SELECT count(*) FROM z) / count(*)::DOUBLE * sum(c) / (SELECT sum(z * z) FROM z), 6) AS moran_i, count(*) AS n_cells FROM l""")
def q_morans_i(spark, sf):
    c = cube.cells(spark, sf)
    edges = spatial.lattice_pairs(c, 1, ["cell_id"])
    return spatial.morans_i(c, edges, "cell_id", "elev").select(R(F.col("moran_i"), 6).alias("moran_i"), "n_cells")


_MIX = "((((({a}) * 73856093 + ({b}) * 19349663) % 2147483647) * ((({a}) * 83492791 + ({b}) * 2654435) % 1000003 + 1)) % 2147483647)"
_MIRROR = f"((({_MIX.format(a='k * 64 + t', b='7919::BIGINT')} % n - x) % n + n) % n)"
_SWAP = f"CASE WHEN ({_MIX.format(a=f'greatest(x, {_MIRROR}) + 1', b='k * 64 + t')} // 1024) % 2 = 1 THEN {_MIRROR} ELSE x END"


@query(f"""
WITH n AS (SELECT count(*) AS n, avg(elev) AS m FROM cells), z AS (SELECT cell_id, row, col, elev - m AS z, n FROM cells, n),
p AS (SELECT cell_id, n, k, 0::BIGINT AS t, cell_id AS x FROM z, range(1, 20) r(k)),
{", ".join(f"p{t + 1} AS (SELECT cell_id, n, k, t + 1 AS t, {_SWAP} AS x FROM p{t or ''})" for t in range(moran.ROUNDS))},
f AS (SELECT p.cell_id, k, z.z FROM p{moran.ROUNDS} p JOIN z ON z.cell_id = p.x UNION ALL SELECT cell_id, 0, z FROM z),
e AS (SELECT a.cell_id, b.cell_id AS near, count(*) OVER (PARTITION BY a.cell_id) AS d FROM cells a JOIN cells b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND a.cell_id <> b.cell_id),
i AS (SELECT f.k, (SELECT count(*) FROM z) / (SELECT count(DISTINCT cell_id) FROM e)::DOUBLE * sum(f.z * g.z / d) / (SELECT sum(z * z) FROM z) AS i FROM e JOIN f USING (cell_id) JOIN f g ON g.cell_id = e.near AND g.k = f.k GROUP BY f.k),
r AS (SELECT (SELECT i FROM i WHERE k = 0) AS own, avg(i) AS mean, stddev_pop(i) AS sd, count(*) FILTER (WHERE i >= (SELECT i FROM i WHERE k = 0)) AS r FROM i WHERE k > 0)
SELECT (SELECT count(*) FROM z) AS n, round(own, 6) AS moran_i, round(-1.0::DOUBLE / ((SELECT count(*) FROM z) - 1), 8) AS expected_i, round((own - mean) / sd, 4) + 0.0 AS z, round((least(r, 19 - r) + 1) / 20.0, 6)::DOUBLE AS p, least(r, 19 - r) AS larger FROM r""")
def q_moran_permutation(spark, sf):
    """z and p of Moran's I from 19 permutations of the cells."""
    c = cube.cells(spark, sf)
    out = moran.moran_test(c, spatial.lattice_pairs(c, 1, ["cell_id"]), "cell_id", "elev", 19)
    return out.select("n", R(F.col("moran_i"), 6).alias("moran_i"), R(F.col("expected_i"), 8).alias("expected_i"), R(F.col("z")).alias("z"), R(F.col("p"), 6).alias("p"), "larger")


@query("""
WITH s AS (SELECT avg(elev) AS m, stddev_pop(elev) AS sd FROM cells), z AS (SELECT cell_id, row, col, (elev - m) / sd AS z FROM cells, s),
p AS (SELECT sqrt((a.row - b.row) ** 2 + (a.col - b.col) ** 2) AS d, a.z * b.z AS zz FROM z a JOIN z b ON abs(a.row - b.row) <= 6 AND abs(a.col - b.col) <= 6 AND a.cell_id < b.cell_id)
SELECT CAST(floor(d * 3 / 6) AS BIGINT) AS bin, round(avg(zz), 6) + 0.0 AS rho, count(*) AS pairs FROM p WHERE d < 6 GROUP BY 1""")
def q_correlogram(spark, sf):
    return spatial.correlogram(cube.cells(spark, sf), "cell_id", "elev", 6, 3).select("bin", R(F.col("rho"), 6).alias("rho"), "pairs")


@query("""
WITH o AS (SELECT year, row // 5 * 5 + col // 5 AS block, lst FROM obs JOIN cells USING (cell_id)),
g AS (SELECT year, block, avg(lst) AS m, var_samp(lst) AS v, count(*) AS k FROM o GROUP BY ALL HAVING count(*) >= 5),
t AS (SELECT year, var_samp(lst) AS total FROM o GROUP BY year)
SELECT g.year, round(least(greatest((var_samp(m) - avg(v / k)) / any_value(total), 0), 0.95), 6) AS rho, sum(k)::BIGINT AS rows FROM g JOIN t USING (year) GROUP BY g.year""")
def q_block_rho(spark, sf):
    o = cube.observations(spark, sf).join(cube.cells(spark, sf), "cell_id").withColumn("block", grid.block_id(5, cube.WIDTH))
    return spatial.intra_block(o, "year", "block", "lst", 5).select("year", R(F.col("rho"), 6).alias("rho"), "rows")


@query("""
WITH n AS (SELECT a.cell_id, min(sqrt((a.row - b.row) ** 2 + (a.col - b.col) ** 2)) AS d, any_value(a.elev) AS elev, arg_min(b.elev, ((a.row - b.row) ** 2 + (a.col - b.col) ** 2, b.cell_id)) AS near
  FROM cells a JOIN cells b ON abs(a.row - b.row) <= 6 AND abs(a.col - b.col) <= 6 AND (a.row // 5 + a.col // 5) % 3 <> (b.row // 5 + b.col // 5) % 3 GROUP BY a.cell_id)
SELECT CAST(floor(d) AS BIGINT) AS km, count(*) AS n, round(sqrt(avg((elev - near) ** 2)), 4) AS rmse FROM n GROUP BY 1""")
def q_error_vs_distance(spark, sf):
    """Error of the nearest cell of another fold, by distance."""
    c = cube.cells(spark, sf).withColumn("fold", ((F.floor(F.col("row") / 5) + F.floor(F.col("col") / 5)) % 3).cast("int"))
    p = spatial.lattice_pairs(c, 6, ["cell_id", "fold", "elev"]).filter("fold <> fold_b")
    n = p.groupBy("cell_id", "elev").agg(F.sqrt(F.min("d2")).alias("d"), F.min_by("elev_b", F.struct("d2", "cell_id_b")).alias("near"))
    return n.groupBy(F.floor("d").cast("long").alias("km")).agg(F.count(F.lit(1)).alias("n"), R(F.sqrt(F.avg(F.pow(F.col("elev") - F.col("near"), 2)))).alias("rmse"))


@query("""
WITH RECURSIVE e AS (SELECT a.cell_id AS a, b.cell_id AS b FROM cells a JOIN cells b ON a.cls = b.cls AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1),
reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a)
SELECT c.cls, count(DISTINCT p.patch) AS patches FROM (SELECT a, min(b) AS patch FROM reach GROUP BY a) p JOIN cells c ON c.cell_id = p.a GROUP BY c.cls""".replace("WITH RECURSIVE e AS", "WITH e AS"))
def q_patch_density(spark, sf):
    """8-connected patches of each class, by rounds of pointer jumping that write their result until nothing changes."""
    from ..operators.patches import patches

    p = patches(cube.cells(spark, sf).select("cell_id", "row", "col", "cls"), "cls")
    return p.groupBy("cls").agg(F.count_distinct("patch").alias("patches"))


@query("""
WITH px AS (SELECT row AS r, col AS c, row // 5 AS pr, col // 5 AS pc, dense_rank() OVER (ORDER BY cls) AS cls, cell_id FROM cells),
win AS (SELECT w.pr AS wr, w.pc AS wc, px.* FROM (SELECT DISTINCT pr, pc FROM px) w JOIN px ON abs(px.pr - w.pr) <= 1 AND abs(px.pc - w.pc) <= 1),
e AS (SELECT a.wr, a.wc, a.cell_id AS a, b.cell_id AS b FROM win a JOIN win b ON a.wr = b.wr AND a.wc = b.wc AND a.cls = b.cls AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1),
reach AS (SELECT wr, wc, a, b FROM e UNION SELECT r.wr, r.wc, r.a, e.b FROM reach r JOIN e ON r.wr = e.wr AND r.wc = e.wc AND r.b = e.a),
pat AS (SELECT wr, wc, count(DISTINCT m) AS n_patches FROM (SELECT wr, wc, a, min(b) AS m FROM reach GROUP BY ALL) GROUP BY ALL),
val AS (SELECT wr, wc, count(*) AS n_valid, count(DISTINCT cls) AS present FROM win GROUP BY ALL),
adj AS (SELECT a.wr, a.wc, a.cls AS x, b.cls AS y FROM win a JOIN win b ON a.wr = b.wr AND a.wc = b.wc AND abs(a.r - b.r) + abs(a.c - b.c) = 1),
num AS (SELECT wr, wc, x, y, count(*) AS n FROM adj GROUP BY ALL), shr AS (SELECT *, n / sum(n) OVER (PARTITION BY wr, wc) AS p FROM num),
ent AS (SELECT wr, wc, -sum(p * ln(p)) AS h, sum(n) FILTER (WHERE x <> y) / 2 AS unlike FROM shr GROUP BY ALL)
SELECT wr AS cell_row, wc AS cell_col, n_valid, n_patches, CASE WHEN n_valid >= 0.5 * 225 THEN round(100 * n_patches / n_valid::DOUBLE, 6) END AS pd,
 CASE WHEN n_valid >= 0.5 * 225 THEN round(coalesce(unlike, 0) * 100 / n_valid, 6) END AS ed, CASE WHEN n_valid >= 0.5 * 225 THEN round(CASE WHEN present = 1 THEN 100 ELSE 100 * (1 - h / (2 * ln(present::DOUBLE))) END, 6) END AS contag
FROM val JOIN pat USING (wr, wc) JOIN ent USING (wr, wc)""")
def q_landscape_windows(spark, sf):
    """Patch and edge density and contagion of 15 x 15 pixel windows around coarse cells of 5 x 5."""
    c = cube.cells(spark, sf)
    names = c.agg(F.array_sort(F.collect_set("cls")).alias("k")).scalar()  # a fixed few classes
    px = c.withColumn("names", names).withColumn("code", F.array_position("names", F.col("cls")))
    out = tiles.landscape(px, "code", 6, 5, 3)
    return out.withColumns({n: R(F.col(n), 6) for n in ("pd", "ed", "contag")})
