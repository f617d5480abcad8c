"""Exact order statistics of groups of any size, and quantile bins that know atoms.

A group's quantile is found by selection: one pass counts a group's values in
equal bins between its least and greatest one, the bin that holds the wanted
rank becomes the new range, and so on until at most ``small`` rows are left or
all of them are equal; only those rows are sorted. Bin counts combine before the
shuffle, so a task never holds a group, and a group that holds a third of all
rows costs what any other does. Results are those of linear interpolation
between order statistics.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored

BINS = 1024


def finite(v: Column) -> Column:
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def quantiles(df: DataFrame, by: list[str], value: Column, probs: list[float], *, small: int = 1 << 16) -> DataFrame:
    """by, n, q (array of the values at ``probs``): exact quantiles of each group's finite values.

    Null, NaN and infinite values take no part and a group without others has
    no row; a null key is a group like any other.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    key = F.struct(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]) if by else F.struct(F.lit(0).alias("_k0"))
    # One text for each group, so that null keys join like others.
    rows = df.select(key.alias("_g"), finite(value.cast("double")).alias("v")).filter("v is not null")
    rows = stored(rows.withColumn("g", F.to_json("_g", {"ignoreNullFields": "false"})), "values")
    ranges = rows.groupBy("g").agg(F.first("_g").alias("_g"), F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    ranges = stored(ranges, "groups")
    at = F.col("p") * (F.col("n") - 1)
    wanted = ranges.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs]))).withColumn("rank", F.explode(F.array(F.floor(at), F.ceil(at)))).dropDuplicates(["g", "rank"])
    # Of ranks counted from ``below`` on, the one wanted lies among ``rows`` values from low to high.
    state = wanted.select("g", "rank", "low", "high", F.lit(0).cast("long").alias("below"), F.col("n").alias("rows"))
    values = rows.select("g", "v")
    while True:
        state = stored(state, "ranges")
        wide = state.filter((F.col("rows") > small) & (F.col("low") < F.col("high")))
        if wide.isEmpty():
            break
        spans = wide.select("g", "low", "high").distinct()
        inside = values.join(spans, "g").filter((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))
        share = (F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)  # halves, so that the range stays finite
        b = F.least(F.floor(share * BINS), F.lit(BINS - 1))
        bins = inside.groupBy("g", "low", "high", b.alias("b")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("a"), F.max("v").alias("z"))
        before = F.sum("c").over(Window.partitionBy("g", "low", "high").orderBy("b")) - F.col("c")
        bins = bins.withColumn("before", before)
        met = wide.join(bins, ["g", "low", "high"]).filter((F.col("rank") - F.col("below") >= F.col("before")) & (F.col("rank") - F.col("below") < F.col("before") + F.col("c")))
        narrowed = met.select("g", "rank", F.col("a").alias("low"), F.col("z").alias("high"), (F.col("below") + F.col("before")).alias("below"), F.col("c").alias("rows"))
        state = state.filter(~((F.col("rows") > small) & (F.col("low") < F.col("high")))).unionByName(narrowed)
    level = state.filter("low = high").select("g", "rank", F.col("low").alias("v"))
    few = state.filter("low < high")
    spans = few.select("g", "low", "high", "below").distinct()
    inside = values.join(spans, "g").filter((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))
    ranked = inside.withColumn("rank", F.col("below") + F.row_number().over(Window.partitionBy("g", "low", "high").orderBy("v")) - 1)
    found = level.unionByName(ranked.join(few.select("g", "rank"), ["g", "rank"]).select("g", "rank", "v"))
    of = found.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("m"))
    out = ranges.join(of, "g")

    def interpolated(p: float) -> Column:
        h = F.lit(float(p)) * (F.col("n") - 1)
        lo, hi = F.element_at("m", F.floor(h)), F.element_at("m", F.ceil(h))
        return lo + (hi - lo) * (h - F.floor(h))

    return out.select(*[F.col(f"_g.{k}").alias(c) for c, k in zip(by, keys, strict=True)], "n", F.array(*[interpolated(p) for p in probs]).alias("q"))


def running(df: DataFrame, by: list[str], along: list[str], amount: Column, name: str = "before") -> DataFrame:
    """``df`` with the sum of ``amount`` over the rows of its group that come before it; ``along`` orders a group, nulls first.

    Rows are cut into ranges of (group, order), a range adds up its own rows, and
    what the ranges before it hold is added: a few groups use all tasks. Rows that
    are equal in ``along`` share a range; count them together first where they may be many.
    """
    cut = df.withColumn("_running_amount", amount).repartitionByRange(*by, *along).withColumn("_running_part", F.spark_partition_id())
    cut = stored(cut, "ranges")
    w = Window.partitionBy("_running_part", *by).orderBy(*along).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(*by).orderBy("_running_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = cut.groupBy("_running_part", *by).agg(F.sum("_running_amount").alias("_running_sum")).withColumn("_running_prior", F.coalesce(F.sum("_running_sum").over(ahead), F.lit(0)))  # a row for each range and group in it
    whole = whole.select(F.col("_running_part").alias("_running_p"), *[F.col(c).alias(f"_running_b{i}") for i, c in enumerate(by)], "_running_prior")
    same = [F.col(c).eqNullSafe(F.col(f"_running_b{i}")) for i, c in enumerate(by)]
    d = cut.withColumn("_running_own", F.coalesce(F.sum("_running_amount").over(w), F.lit(0))).join(whole, [F.col("_running_part") == F.col("_running_p"), *same])
    return d.select(*df.columns, (F.col("_running_own") + F.col("_running_prior")).alias(name))


def ranks(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, value, below, equal, n: of each value of a group the number of smaller and of equal ones, and the group's size; nulls take no part."""
    g = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("equal"))
    r = stored(running(g, by, [value], F.col("equal"), "below"), "ranks")
    whole = r.groupBy(*[F.col(c).alias(f"_running_b{i}") for i, c in enumerate(by)]).agg(F.sum("equal").alias("n"))
    same = [F.col(c).eqNullSafe(F.col(f"_running_b{i}")) for i, c in enumerate(by)]
    j = r.join(whole, same) if by else r.crossJoin(F.broadcast(whole))  # one row
    return j.select(*by, value, "below", "equal", "n")


def atom_edges(df: DataFrame, value: Column, bins: int, *, small: int = 1 << 16) -> list[float]:
    """Edges of at most about ``bins`` bins (the last one closed): a value that holds 1/bins of all rows is a bin of its own, the rest is cut at quantiles.

    Empty bins go to the one before; while atoms make too many, the smallest bin
    that is no atom joins the smaller of its neighbours that are none. Atoms and
    quantiles are at most ``2 * bins`` numbers, all that the driver sees; counts
    of bins add up as bins merge, so the data is not read again.
    """
    bins = max(1, bins)
    rows = stored(df.select(finite(value.cast("double")).alias("v")).filter("v is not null"), "values")
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).first()
    if not whole["n"]:
        return [0.0, 0.0]
    common = rows.groupBy("v").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") * bins >= whole["n"])
    atoms = sorted(r["v"] for r in common.collect())
    rest = rows.filter(~F.col("v").isin(atoms)) if atoms else rows
    pieces = max(1, bins - len(atoms))
    cuts = quantiles(rest, [], F.col("v"), [i / pieces for i in range(pieces + 1)], small=small).first()
    edges = sorted({whole["low"], whole["high"], *atoms, *np.nextafter(atoms, np.inf).tolist(), *(cuts["q"] if cuts else [])})
    if len(edges) < 2:
        return edges * 2
    counts = [0] * (len(edges) - 1)
    for r in rows.groupBy(bin_of(F.col("v"), edges).alias("b")).count().collect():
        counts[r["b"]] = r["count"]
    kept = [(e, c) for e, c in zip(edges, counts, strict=False) if c]  # the first bin holds the least value
    while len(kept) > bins:
        ends = [e for e, _ in kept[1:]] + [edges[-1]]
        alone = [e in atoms and z == np.nextafter(e, np.inf) for (e, _), z in zip(kept, ends, strict=True)]
        pairs = [(kept[i][1], i, kept[j][1], j) for i in range(len(kept)) for j in (i - 1, i + 1) if 0 <= j < len(kept) and not alone[i] and not alone[j]]
        if not pairs:
            break
        _, i, _, j = min(pairs)
        a = min(i, j)
        kept[a : a + 2] = [(kept[a][0], kept[a][1] + kept[a + 1][1])]
    return [e for e, _ in kept] + [edges[-1]]


def bin_of(value: Column, edges: list[float]) -> Column:
    """Number of the bin, by binary search in nested CASEs; null for null and NaN."""
    inner = edges[1:-1]

    def search(a: int, z: int) -> Column:
        if a == z:
            return F.lit(a)
        mid = (a + z) // 2
        return F.when(value < float(inner[mid]), search(a, mid)).otherwise(search(mid + 1, z))

    return F.when(~F.isnan(value), search(0, len(inner)))
