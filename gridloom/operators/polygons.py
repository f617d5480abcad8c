"""Points in polygons by equi-joins on tiles, and names that are nearly right.

A polygon is sent to the tiles of its bounding box and its edges to the rows of
tiles they pass through. A point meets the polygons of its tile, and of those
only the edges in its own row of tiles, enough to count how often a ray to the
right crosses the outline. Rings count by parity, so holes are holes; a point on
an edge or a corner is inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edges_of(rings: DataFrame) -> DataFrame:
    """polygon, x1, y1, x2, y2 from rings (polygon, ring: array of (x, y)); the last corner joins the first."""
    n = F.size("ring")
    at = rings.filter(n >= 3).select("polygon", "ring", F.posexplode("ring").alias("i", "p"))
    q = F.get("ring", F.pmod(F.col("i") + 1, F.size("ring")))
    return at.select("polygon", F.col("p.x").alias("x1"), F.col("p.y").alias("y1"), q["x"].alias("x2"), q["y"].alias("y2"))


def containing(points: DataFrame, rings: DataFrame, key: str, size: float, salts: int = 8) -> DataFrame:
    """key, polygon: every polygon that a point (key, x, y) lies in, its outline included.

    ``size``: the side of a tile; a few edges should pass through a row of tiles.
    Points of a crowded tile are dealt over ``salts`` parts. Points or corners
    with a null coordinate take no part, nor do rings of fewer than 3 corners; a
    repeated key is one point for each different place.
    """
    tile = lambda c: F.floor(c / size)
    span = lambda a, b: F.explode(F.sequence(tile(F.least(a, b)), tile(F.greatest(a, b))))
    e = edges_of(rings).dropna()
    box = e.groupBy("polygon").agg(F.min(F.least("x1", "x2")).alias("x0"), F.max(F.greatest("x1", "x2")).alias("x9"), F.min(F.least("y1", "y2")).alias("y0"), F.max(F.greatest("y1", "y2")).alias("y9"))
    salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    places = box.withColumn("tx", span(F.col("x0"), F.col("x9"))).withColumn("ty", span(F.col("y0"), F.col("y9"))).select("*", salt)
    p = points.select(F.col(key).alias("_key"), F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py")).filter("px is not null and py is not null").distinct()
    p = p.withColumns({"tx": tile(F.col("px")), "ty": tile(F.col("py")), "salt": F.pmod(F.xxhash64("_key", "px", "py"), F.lit(salts)).cast("int")})
    near = p.join(places, ["tx", "ty", "salt"]).filter("px between x0 and x9 and py between y0 and y9").select("_key", "px", "py", "polygon", "ty", "salt")
    cut = e.withColumn("ty", span(F.col("y1"), F.col("y2"))).select("*", salt)
    met = near.join(cut, ["polygon", "ty", "salt"])
    side = (F.col("x2") - F.col("x1")) * (F.col("py") - F.col("y1")) - (F.col("y2") - F.col("y1")) * (F.col("px") - F.col("x1"))
    within = lambda v, a, b: v.between(F.least(a, b), F.greatest(a, b))
    on = (side == 0) & within(F.col("px"), F.col("x1"), F.col("x2")) & within(F.col("py"), F.col("y1"), F.col("y2"))
    up = F.col("y2") > F.col("y1")
    crosses = ((F.col("y1") > F.col("py")) != (F.col("y2") > F.col("py"))) & F.when(up, side > 0).otherwise(side < 0)
    g = met.groupBy("_key", "px", "py", "polygon").agg(F.count_if(crosses).alias("n"), F.max(on).alias("on"))
    return g.filter("on or n % 2 = 1").select(F.col("_key").alias(key), "polygon").distinct()


def nearest_name(name: Column, names: list[tuple[int, str]], most: int = 2) -> Column:
    """The number of the name with the least edit distance, at most ``most``; ties go to the smaller number, null and far names to none. ``names`` are a stated few."""
    table = F.array(*[F.struct(F.lit(int(k)).alias("k"), F.lit(n).alias("n")) for k, n in names])
    far = F.transform(table, lambda t: F.struct(F.levenshtein(name, t["n"]).alias("d"), t["k"].alias("k")))
    best = F.array_min(F.filter(far, lambda t: t["d"] <= most))
    return best["k"]


def matched(points: DataFrame, rings: DataFrame, key: str, name: str, names: list[tuple[int, str]], size: float) -> DataFrame:
    """key, polygon, how: the smallest polygon number that holds the point, else the one whose name is nearest; null for neither."""
    inside = containing(points, rings, key, size).groupBy(key).agg(F.min("polygon").alias("_in"))
    d = points.select(key, name).distinct().join(inside, key, "left").withColumn("_by", nearest_name(F.col(name), names))
    how = F.when(F.col("_in").isNotNull(), "place").when(F.col("_by").isNotNull(), "name")
    return d.select(key, F.coalesce("_in", "_by").alias("polygon"), how.alias("how"))
