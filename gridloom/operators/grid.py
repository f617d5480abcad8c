"""Neighbourhood operators on a lattice.

A w x w box is two separable passes: sums along a row in tiles, then along a
column, each a window over one row or column, so the largest partition is one
lattice line and not the lattice. Only the lattice's own size matters, never
w * w neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dense(cells: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """Every (row, col) of the bounding box, so that row offsets are cell offsets; ``frames`` multiplies it."""
    b = cells.agg(F.max("row").alias("r"), F.max("col").alias("c")).first()
    spark = cells.sparkSession
    lines = spark.range((b["r"] if b["r"] is not None else -1) + 1).withColumnRenamed("id", "row")
    grid = lines.withColumn("col", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(b["c"] or 0).cast("long"))))
    return grid if frames is None else grid.join(F.broadcast(frames))


def box_sums(df: DataFrame, columns: dict[str, Column], size: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Sums over the size x size box around each cell of a dense lattice, clipped at its edge; nulls add nothing."""
    h = size // 2
    along = Window.partitionBy(*by, "row").orderBy("col").rowsBetween(-h, h)
    down = Window.partitionBy(*by, "col").orderBy("row").rowsBetween(-h, h)
    d = df
    for name, c in columns.items():
        d = d.withColumn(f"_{name}", F.sum(F.coalesce(c.cast("double"), F.lit(0.0))).over(along))
    for name in columns:
        d = d.withColumn(name, F.sum(f"_{name}").over(down)).drop(f"_{name}")
    return d


def box_mean(df: DataFrame, value: str, size: int, by: tuple[str, ...] = (), name: str = "box_mean") -> DataFrame:
    """Mean of the valid cells of the box."""
    v = F.col(value)
    d = box_sums(df, {"_s": v, "_n": F.when(v.isNotNull(), 1)}, size, by)
    return d.withColumn(name, F.when(F.col("_n") > 0, F.col("_s") / F.col("_n"))).drop("_s", "_n")


def box_std(df: DataFrame, value: str, size: int, by: tuple[str, ...] = (), name: str = "box_std") -> DataFrame:
    """Population standard deviation of the valid cells of the box; values are centred first."""
    centre = df.agg(F.avg(value)).first()[0] or 0.0
    v = F.col(value) - F.lit(centre)
    d = box_sums(df, {"_s": v, "_q": v * v, "_n": F.when(v.isNotNull(), 1)}, size, by)
    var = F.col("_q") / F.col("_n") - F.pow(F.col("_s") / F.col("_n"), 2)
    return d.withColumn(name, F.when(F.col("_n") > 0, F.sqrt(F.greatest(var, F.lit(0.0))))).drop("_s", "_q", "_n")


def distance(df: DataFrame, target: Column, size: float = 1.0) -> DataFrame:
    """Euclidean distance to the nearest target cell of a dense lattice.

    Pass 1: nearest target row within each column, from windows. Pass 2: along
    a row, the least of (column offset, that column's distance). A cell meets
    the columns of its own row, never all targets.
    """
    w, back = Window.partitionBy("col").orderBy("row"), Window.partitionBy("col").orderBy(F.desc("row"))  # frames that only grow: one pass each
    hit = F.when(target, F.col("row"))
    d = df.withColumn("_up", F.last(hit, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("_down", F.last(hit, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("_v", F.least(F.col("row") - F.col("_up"), F.col("_down") - F.col("row")))
    line = d.groupBy("row").agg(F.collect_list(F.when(F.col("_v").isNotNull(), F.struct("col", "_v"))).alias("_line"))
    out = d.join(line.hint("merge"), "row")
    near = F.array_min(F.transform("_line", lambda p: (p["col"] - F.col("col")) * (p["col"] - F.col("col")) + p["_v"] * p["_v"]))
    return out.withColumn("distance", F.sqrt(near.cast("double")) * size).drop("_up", "_down", "_v", "_line")


def adjacency(df: DataFrame, cls: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts of class pairs of right and lower neighbours, both ways: the symmetric adjacency matrix."""
    right = Window.partitionBy(*by, "row").orderBy("col")
    down = Window.partitionBy(*by, "col").orderBy("row")
    d = df.select(*by, F.col(cls).alias("a"), F.lead(cls).over(right).alias("_r"), F.lead(cls).over(down).alias("_d"))
    pairs = d.select(*by, "a", F.explode(F.array("_r", "_d")).alias("b")).filter("a is not null and b is not null")
    both = pairs.union(pairs.select(*by, F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy(*by, "a", "b").agg(F.count(F.lit(1)).alias("n"))


def contagion(adj: DataFrame, classes: int, by: tuple[str, ...] = ()) -> DataFrame:
    """100 * (1 + sum p ln p / (2 ln classes)) of the adjacency shares."""
    total = F.sum("n").over(Window.partitionBy(*by))
    p = adj.withColumn("_p", F.col("n") / total)
    return p.groupBy(*by).agg((100 * (1 + F.sum(F.col("_p") * F.log("_p")) / (2 * F.log(F.lit(float(classes)))))).alias("contagion"), F.sum("n").alias("pairs"))


def bilinear(points: DataFrame, lattice: DataFrame, value: str) -> DataFrame:
    """Value at fractional (y, x) from the four corners; missing corners are left out and the weights renormalised."""
    p = points.withColumn("_r", F.floor("y").cast("long")).withColumn("_c", F.floor("x").cast("long"))
    corners = F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for i in (0, 1) for j in (0, 1)])
    p = p.withColumn("_k", F.explode(corners)).withColumn("row", F.col("_r") + F.col("_k.i")).withColumn("col", F.col("_c") + F.col("_k.j"))
    p = p.withColumn("_w", (1 - F.abs(F.col("y") - F.col("row"))) * (1 - F.abs(F.col("x") - F.col("col"))))
    met = p.join(lattice.select("row", "col", F.col(value).alias("_v")).filter("_v is not null"), ["row", "col"])
    return met.groupBy("point_id").agg(F.try_divide(F.sum(F.col("_w") * F.col("_v")), F.sum("_w")).alias(value))


def block_id(block: int, width: int) -> Column:
    """Number of the block x block tile of (row, col)."""
    across = -(-width // block)
    return (F.floor(F.col("row") / block) * across + F.floor(F.col("col") / block)).cast("long")


def greedy_folds(counts: list[tuple[int, int]], folds: int) -> dict[int, int]:
    """Largest block first, to the least loaded fold (ties: lowest); blocks number in the hundreds."""
    load, out = [0] * folds, {}
    for block, n in sorted(counts, key=lambda x: (-x[1], x[0])):
        k = min(range(folds), key=lambda i: (load[i], i))
        out[block] = k
        load[k] += n
    return out
