"""Thresholds of binned curves: zero crossing, breakpoint and saturation, with block-bootstrap support.

A curve is a small table (group, c, m, w): mean abscissa, mean value and weight of
each bin. Rows become curves in one grouped pass; replicates reweight the sums of
blocks, so the rows are read once however many replicates there are. All later
steps work on curves alone, keyed by group and replicate: rows x bins x candidates
of a group never meet in one place.

A null group is a group like any other; bins with null, NaN or infinite values or
no weight take no part; what a curve does not have is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import order
from .draws import uniform
from .scratch import stored

#: The rules of the three thresholds.
DOMINANCE, LEAST_BINS = 2.0, 5
EDGE, GAIN, SIDE_BINS, SIDE_WEIGHT, STEPS = 0.1, 0.9, 5, 0.05, 121
FLAT, TAIL, RUN, KNEE_STEPS = 0.1, 0.25, 3, 81
SUPPORT, INTERVAL = 0.5, (0.025, 0.5, 0.975)
#: Cumulative Poisson(1) probabilities of 0, 1, 2, ...: a block's weight in a replicate.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)


def _rows(df: DataFrame, by: list[str], **columns: Column) -> DataFrame:
    """The groups' keys and ``columns`` under names of their own, complete rows only."""
    x, y = (order.finite(columns.pop(v).cast("double")).alias(f"_{v}") for v in ("x", "y"))
    rest = [c.alias(f"_{n}") for n, c in columns.items()]
    return df.select(*by, *rest, x, y).dropna(subset=["_x", "_y", *[f"_{n}" for n in columns]])


def binned(df: DataFrame, by: list[str], bin_: Column, x: Column, y: Column) -> DataFrame:
    """by, c, m, w: mean x, mean y and number of rows of each bin. Keys may have any names but these three."""
    g = _rows(df, by, bin=bin_, x=x, y=y).groupBy(*by, "_bin")
    return g.agg(F.avg("_x").alias("c"), F.avg("_y").alias("m"), F.count(F.lit(1)).cast("double").alias("w")).drop("_bin")


def replicated(df: DataFrame, by: list[str], block: Column, bin_: Column, x: Column, y: Column, replicates: int, seed: int) -> DataFrame:
    """by, rep, c, m, w: the curves of Poisson-weighted blocks (a whole number each), replicate by replicate from 1.

    Draws are keyed by block and replicate, so reruns agree; only block sums are repeated.
    """
    rows = _rows(df, by, block=block.cast("long"), bin=bin_, x=x, y=y)
    sums = rows.groupBy(*by, "_block", "_bin").agg(F.sum("_x").alias("_sx"), F.sum("_y").alias("_sy"), F.count(F.lit(1)).alias("_n"))
    r = sums.withColumn("rep", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(replicates).cast("long"))))
    u = uniform(seed, 0, F.col("_block"), F.col("rep"))
    r = r.withColumn("_k", F.size(F.filter(F.array(*[F.lit(p) for p in POISSON]), lambda p: p <= u))).filter("_k > 0")
    total = lambda c: F.sum(F.col("_k") * F.col(c))
    g = r.groupBy(*by, "rep", "_bin").agg(total("_sx").alias("_sx"), total("_sy").alias("_sy"), total("_n").cast("double").alias("w"))
    return g.select(*by, "rep", (F.col("_sx") / F.col("w")).alias("c"), (F.col("_sy") / F.col("w")).alias("m"), "w")


def _line(evenly: int) -> Column:
    """Candidates: ``evenly`` points from ``from`` to ``to``."""
    return F.transform(F.sequence(F.lit(0), F.lit(evenly - 1)), lambda k: F.col("from") + (F.col("to") - F.col("from")) * k / float(evenly - 1))


def _hinges(points: DataFrame, asked: DataFrame) -> DataFrame:
    """g, h, before, after, sse, line, left, right, wl, wr: the best weighted hinge of each group.

    ``asked`` holds g and h. Candidates whose hinge is collinear with the line fit the line;
    of those that fit equally well (to 1e-9 of the spread) the smallest is taken.
    """
    d = asked.join(points.select("g", "c", "m", "w"), "g")
    x, y, h = F.col("c"), F.col("m"), F.greatest(F.lit(0.0), F.col("c") - F.col("h"))
    mean = lambda v: F.sum(F.col("w") * v) / F.sum("w")
    cov = lambda a, b: mean(a * b) - mean(a) * mean(b)
    left = F.col("c") <= F.col("h")
    s = d.groupBy("g", "h").agg(
        cov(x, x).alias("xx"), cov(h, h).alias("hh"), cov(x, h).alias("xh"), cov(x, y).alias("xy"), cov(h, y).alias("hy"), cov(y, y).alias("yy"), F.sum("w").alias("sw"),
        F.count_if(left).alias("left"), F.count_if(~left).alias("right"), F.sum(F.when(left, F.col("w")).otherwise(0.0)).alias("wl"), F.sum(F.when(left, 0.0).otherwise(F.col("w"))).alias("wr"),
    )
    det = F.col("xx") * F.col("hh") - F.col("xh") * F.col("xh")
    s = s.withColumn("det", F.when(det > 1e-10 * F.col("xx") * F.col("hh"), det))
    slope = F.coalesce((F.col("xy") * F.col("hh") - F.col("hy") * F.col("xh")) / F.col("det"), F.try_divide(F.col("xy"), F.col("xx")))
    bend = F.coalesce((F.col("hy") * F.col("xx") - F.col("xy") * F.col("xh")) / F.col("det"), F.lit(0.0))
    s = s.withColumn("slope", slope).withColumn("bend", bend)
    s = s.withColumn("line", F.col("sw") * (F.col("yy") - F.coalesce(F.try_divide(F.col("xy") * F.col("xy"), F.col("xx")), F.lit(0.0))))
    s = s.withColumn("sse", F.greatest(F.lit(0.0), F.col("sw") * (F.col("yy") - F.coalesce(F.col("slope"), F.lit(0.0)) * F.col("xy") - F.col("bend") * F.col("hy"))))
    s = s.withColumn("least", F.min("sse").over(Window.partitionBy("g")))
    best = s.filter(F.col("sse") <= F.col("least") + 1e-9 * F.col("sw") * F.col("yy"))
    rest = ["sse", "line", "left", "right", "wl", "wr"]
    return best.groupBy("g").agg(F.min_by(F.struct("h", F.col("slope").alias("before"), (F.col("slope") + F.col("bend")).alias("after"), *rest), "h").alias("b")).select("g", "b.*")


def thresholds(curve: DataFrame, by: list[str]) -> DataFrame:
    """by, zero_crossing, multiple, breakpoint, slope_before, slope_after, saturation, slope, effect_range, bins.

    zero_crossing: the sign change of the curve (by interpolation), or the one whose jump is at
    least twice any other's; ``multiple`` says there were several and none dominates.
    breakpoint: the best weighted hinge if it explains a tenth more than the line, is no end of
    its range and leaves five bins and 5 % of the weight on either side.
    saturation: after the steepest place, where three slopes of the smoothed curve in a row stay below a
    tenth of it and at most a quarter of the range is still to come, moved to the knee before.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    group = F.struct(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]) if by else F.struct(F.lit(0).alias("_k0"))
    p = curve.select(group.alias("_g"), *[order.finite(F.col(v).cast("double")).alias(v) for v in "cmw"]).filter("c is not null and m is not null and w > 0")
    p = p.withColumn("g", F.to_json("_g", {"ignoreNullFields": "false"}))
    of, along = Window.partitionBy("g"), Window.partitionBy("g").orderBy("c", "m")
    p = stored(p.withColumn("i", F.row_number().over(along) - 1).withColumn("n", F.count(F.lit(1)).over(of)), "curves")
    along = Window.partitionBy("g").orderBy("i")

    cov = lambda a, b: F.sum(F.col("w") * a * b) / F.sum("w") - F.sum(F.col("w") * a) / F.sum("w") * F.sum(F.col("w") * b) / F.sum("w")
    whole = p.groupBy("g").agg(
        F.first("_g").alias("_g"), F.count(F.lit(1)).alias("bins"), (F.max("m") - F.min("m")).alias("effect_range"), F.max(F.abs("c")).alias("far"), F.sum("w").alias("sw"),
        F.when((F.count(F.lit(1)) >= 3) & (F.max("c") > F.min("c")), F.try_divide(cov(F.col("c"), F.col("m")), cov(F.col("c"), F.col("c")))).alias("slope"),
    )

    step = p.select("g", "c", "m", F.lead("c").over(along).alias("c1"), F.lead("m").over(along).alias("m1")).filter("(m < 0 and m1 >= 0) or (m > 0 and m1 <= 0)")
    jumps = step.select("g", F.struct(F.abs(F.col("m1") - F.col("m")).alias("jump"), (F.col("c") - F.col("m") * (F.col("c1") - F.col("c")) / (F.col("m1") - F.col("m"))).alias("x")).alias("s"))
    top = jumps.groupBy("g").agg(F.slice(F.sort_array(F.collect_list("s"), asc=False), 1, 2).alias("t"))  # at most one for each bin
    dominant = (F.size("t") == 1) | (F.get("t", F.lit(0))["jump"] >= DOMINANCE * F.get("t", F.lit(1))["jump"])
    zero = top.select("g", F.when(dominant, F.get("t", F.lit(0))["x"]).alias("zero_crossing"), (~dominant).alias("multiple"))

    low, high = F.greatest(F.lit(1), F.floor(EDGE * (F.col("n") - 1))), F.least(F.col("n") - 2, F.ceil((1 - EDGE) * (F.col("n") - 1)))
    inner = p.filter((F.col("n") >= LEAST_BINS) & F.col("i").between(low, high)).groupBy("g").agg(F.min("c").alias("from"), F.max("c").alias("to"), F.collect_set("c").alias("cs"))
    inner = inner.filter(F.col("from") < F.col("to"))
    b = _hinges(p, inner.select("g", F.explode(F.array_distinct(F.concat("cs", _line(STEPS)))).alias("h"))).join(inner.select("g", "from", "to"), "g").join(whole.select("g", "far", "sw"), "g")
    eps = 1e-9 * F.greatest(F.lit(1.0), F.col("far"))
    sides = (F.least("left", "right") >= SIDE_BINS) & (F.least("wl", "wr") >= SIDE_WEIGHT * F.col("sw"))
    b = b.filter((F.col("line") > 1e-12) & (F.col("sse") <= GAIN * F.col("line")) & (F.col("h") > F.col("from") + eps) & (F.col("h") < F.col("to") - eps) & sides)
    b = b.select("g", F.col("h").alias("breakpoint"), F.col("before").alias("slope_before"), F.col("after").alias("slope_after"))

    ends = Window.partitionBy("g").orderBy("i").rowsBetween(-1, 1)
    s = p.withColumn("gap", F.col("c") - F.lag("c").over(along)).withColumn("least", F.min("gap").over(of)).filter((F.col("n") >= LEAST_BINS) & (F.col("least") > 0))
    s = s.withColumn("v", F.sum("m").over(ends) / F.count(F.lit(1)).over(ends))
    vp, vn, a, z = F.lag("v").over(along), F.lead("v").over(along), F.col("gap"), F.lead("gap").over(along)
    inside = (a * a * vn + (z * z - a * a) * F.col("v") - z * z * vp) / (a * z * (a + z))
    s = s.withColumn("s", F.abs(F.coalesce(inside, (vn - F.col("v")) / z, (F.col("v") - vp) / a)))
    s = s.withColumn("steepest", F.max("s").over(of)).filter("steepest > 0").withColumn("steep", F.min(F.when(F.col("s") >= F.col("steepest") * (1 - 1e-9), F.col("i"))).over(of))
    s = s.withColumn("flat", (F.col("s") < FLAT * F.col("steepest")).cast("int")).withColumn("run", F.sum("flat").over(along.rowsBetween(0, RUN - 1)))
    s = s.withColumn("tail", F.abs(F.max_by("v", "i").over(of) - F.col("v"))).withColumn("span", F.max("v").over(of) - F.min("v").over(of))
    met = (F.col("i") > F.col("steep")) & (F.col("run") == RUN) & (F.col("tail") <= TAIL * F.col("span"))
    s = s.withColumn("onset", F.min(F.when(met, F.col("i"))).over(of)).filter("onset is not null")
    s = s.filter(F.col("i").between(F.greatest(F.col("steep"), F.col("onset") - 4), F.col("onset") + 2)).withColumn("w", F.lit(1.0))
    s = stored(s.select("g", "i", "onset", "c", "m", "w"), "knees")
    knee = s.groupBy("g").agg(F.min("c").alias("from"), F.max(F.when(F.col("i") == F.col("onset"), F.col("c"))).alias("to"))
    knee = _hinges(s, knee.select("g", F.explode(_line(KNEE_STEPS)).alias("h"))).select("g", F.col("h").alias("saturation"))

    out = whole.join(zero, "g", "left").join(b, "g", "left").join(knee, "g", "left").withColumn("multiple", F.coalesce("multiple", F.lit(False)))
    return out.select(*[F.col(f"_g.{k}").alias(c) for c, k in zip(by, keys, strict=True)], "zero_crossing", "multiple", "breakpoint", "slope_before", "slope_after", "saturation", "slope", "effect_range", "bins")


def crossing_tolerance(df: DataFrame, by: list[str], x: Column, edges: list[float]) -> DataFrame:
    """by, tolerance: the greater of a bin's median width (bins without width apart) and a tenth of the range from p05 to p95."""
    scale = max(1.0, max(map(abs, edges), default=0.0))
    widths = sorted(b - a for a, b in zip(edges, edges[1:], strict=False) if b - a > 1e-9 * scale)
    half = len(widths) // 2
    median = 0.0 if not widths else widths[half] if len(widths) % 2 else (widths[half - 1] + widths[half]) / 2
    q = order.quantiles(df, by, x, [0.05, 0.95])
    return q.select(*by, F.greatest(F.lit(float(median)), 0.1 * (F.col("q")[1] - F.col("q")[0])).alias("tolerance"))


def supported(point: DataFrame, replicates: DataFrame, by: list[str], tolerance: DataFrame) -> DataFrame:
    """``point`` with <name>_lo, <name>_hi and <name>_support for each of the three thresholds.

    Support is the share of replicates that have the threshold (a crossing counts only
    within the tolerance of the point's own); the interval is that of the replicates,
    moved by the difference of point and median, where at least half of them have it.
    """
    names = ["zero_crossing", "breakpoint", "saturation"]
    same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in by]
    ref = point.select(*by, F.col("zero_crossing").alias("ref"))
    ref = ref.join(tolerance, same(ref, tolerance), "left").select(*[ref[c] for c in by], "ref", "tolerance")
    r = replicates.join(ref, same(replicates, ref), "left").select(*[replicates[c] for c in by], *names, "ref", "tolerance")
    r = r.withColumn("zero_crossing", F.when(F.col("ref").isNull() | (F.abs(F.col("zero_crossing") - F.col("ref")) <= F.col("tolerance")), F.col("zero_crossing")))
    q = [F.percentile(n, F.array(*[F.lit(p) for p in INTERVAL])).alias(f"_q_{n}") for n in names]
    r = r.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *q, *[F.count(n).alias(f"_c_{n}") for n in names])
    j = point.join(r, same(point, r), "left")
    extra = []
    for n in names:
        share = F.coalesce(F.col(f"_c_{n}") / F.col("_n"), F.lit(0.0))
        ok = point[n].isNotNull() & (share >= SUPPORT) & (F.col(f"_c_{n}") >= 2)
        at = lambda k: F.when(ok, point[n] + F.col(f"_q_{n}")[k] - F.col(f"_q_{n}")[1])  # noqa: B023, E731
        extra += [at(0).alias(f"{n}_lo"), at(2).alias(f"{n}_hi"), F.when(point[n].isNotNull(), share).alias(f"{n}_support")]
    return j.select(*[point[c] for c in point.columns], *extra)
