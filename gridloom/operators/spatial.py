"""Neighbours, spatial statistics and vector assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lattice_pairs(df: DataFrame, reach: int, keep: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Ordered pairs of different cells at most ``reach`` rows and columns apart.

    The plane is cut into tiles of ``reach`` cells. A point is sent to its own
    tile and the eight around it, and pairs are met by an equi-join on the tile,
    so the work follows the local density, not the square of the table. The join
    merges: the nine copies look small to the planner, and a broadcast would pass
    them through the driver.
    """
    tile = lambda c: F.floor(F.col(c) / reach).cast("long")
    a = df.select(*by, *keep, "row", "col", tile("row").alias("_tr"), tile("col").alias("_tc"))
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    b = df.select(*by, *[F.col(k).alias(f"{k}_b") for k in keep], F.col("row").alias("row_b"), F.col("col").alias("col_b"), F.explode(near).alias("_k"))
    b = b.withColumn("_tr", F.floor(F.col("row_b") / reach).cast("long") + F.col("_k.i")).withColumn("_tc", F.floor(F.col("col_b") / reach).cast("long") + F.col("_k.j")).drop("_k")
    pairs = a.join(b.hint("merge"), [*by, "_tr", "_tc"]).filter((F.abs(F.col("row") - F.col("row_b")) <= reach) & (F.abs(F.col("col") - F.col("col_b")) <= reach))
    d2 = F.pow(F.col("row") - F.col("row_b"), 2) + F.pow(F.col("col") - F.col("col_b"), 2)
    return pairs.filter((F.col("row") != F.col("row_b")) | (F.col("col") != F.col("col_b"))).withColumn("d2", d2).drop("_tr", "_tc")


def knn(df: DataFrame, key: str, k: int, reach: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The k nearest cells within ``reach``, ties by key."""
    w = Window.partitionBy(*by, key).orderBy("d2", f"{key}_b")
    return lattice_pairs(df, reach, [key], by).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def morans_i(values: DataFrame, edges: DataFrame, key: str, value: str) -> DataFrame:
    """Moran's I with row-standardised weights over ``key, key_b`` edges."""
    m = values.agg(F.avg(value)).first()[0] or 0.0
    z = values.select(F.col(key), (F.col(value) - m).alias("z"))
    zb = z.select(F.col(key).alias(f"{key}_b"), F.col("z").alias("z_b"))
    e = edges.select(key, f"{key}_b").join(z.hint("merge"), key).join(zb.hint("merge"), f"{key}_b")  # never all sites in the driver
    lag = e.groupBy(key).agg((F.max("z") * F.avg("z_b")).alias("c"))
    cross = lag.agg(F.sum("c").alias("cross"), F.count(F.lit(1)).cast("double").alias("s0"))
    whole = z.agg(F.sum(F.col("z") * F.col("z")).alias("ss"), F.count(F.lit(1)).cast("double").alias("n"))
    return cross.join(F.broadcast(whole)).select((F.col("n") / F.col("s0") * F.col("cross") / F.col("ss")).alias("moran_i"), F.col("s0").cast("long").alias("n_cells"))


def correlogram(df: DataFrame, key: str, value: str, reach: int, bins: int) -> DataFrame:
    """Mean product of standardised values by distance class."""
    s = df.agg(F.avg(value), F.stddev_pop(value)).first()
    z = df.withColumn("z", (F.col(value) - (s[0] or 0.0)) / (s[1] or 1.0))
    p = lattice_pairs(z, reach, [key, "z"]).filter(F.col(key) < F.col(f"{key}_b"))
    d = F.sqrt("d2")
    b = F.floor(d * bins / reach).cast("long")
    return p.filter(d < reach).groupBy(b.alias("bin")).agg(F.avg(F.col("z") * F.col("z_b")).alias("rho"), F.count(F.lit(1)).alias("pairs"))


def intra_block(df: DataFrame, frame: str, block: str, value: str, least: int) -> DataFrame:
    """Share of a frame's variance that lies between blocks, less what block sampling alone gives; in 0 to 0.95."""
    g = df.groupBy(frame, block).agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.count(F.lit(1)).alias("k")).filter(F.col("k") >= least)
    t = df.groupBy(frame).agg(F.var_samp(value).alias("total"))
    r = g.groupBy(frame).agg(F.var_samp("m").alias("between"), F.avg(F.col("v") / F.col("k")).alias("noise"), F.sum("k").alias("rows")).join(t, frame)
    rho = F.try_divide(F.col("between") - F.col("noise"), F.col("total"))
    return r.select(frame, F.least(F.greatest(rho, F.lit(0.0)), F.lit(0.95)).alias("rho"), "rows")


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean vector by label, by position so that partial sums combine before the shuffle."""
    p = df.select(F.col(label).alias("k"), F.posexplode(vector).alias("i", "x"))
    m = p.groupBy("k", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return m.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def nearest_centroid(df: DataFrame, centres: DataFrame, key: str, vector: str, most: int = 1024) -> DataFrame:
    """Nearest of a stated few centres, ties to the smaller number. Centres become one array literal column: no join of pairs."""
    rows = centres.orderBy("k").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} centres")
    table = F.array(*[F.struct(F.lit(r["k"]).alias("k"), F.array(*[F.lit(float(x)) for x in r["centroid"]]).alias("c")) for r in rows])
    v = F.transform(vector, lambda x: x.cast("double"))
    scored = F.transform(table, lambda t: F.struct(squared_distance(v, t["c"]).alias("d2"), t["k"].alias("k")))
    return df.select(key, F.array_min(scored).alias("_b")).select(key, F.col("_b.k").alias("zone"), F.sqrt("_b.d2").alias("distance"))


def dominant(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Position (from 0) of the largest absolute component, ties to the first."""
    a = F.transform(vector, lambda x: F.abs(x))
    return df.select(key, (F.array_position(a, F.array_max(a)) - 1).alias("driver"), F.array_max(a).cast("double").alias("strength"))
