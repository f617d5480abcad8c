"""Regression, calibration, levels and error models as sums; nothing is solved row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import order
from .scratch import stored


def ols_by(df: DataFrame, by: list[str], x: str, y: str, least: int = 2) -> DataFrame:
    """Slope, intercept and R2 by group; groups under ``least`` rows or without spread take the pooled line.

    The pooled line comes from the groups' own centred sums: rows are read once.
    """
    own = df.groupBy(*by).agg(
        F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"), F.regr_r2(y, x).alias("r2"), F.count(F.lit(1)).alias("n"),
        F.regr_count(y, x).alias("_k"), F.regr_avgx(y, x).alias("_x"), F.regr_avgy(y, x).alias("_y"), F.regr_sxx(y, x).alias("_xx"), F.regr_sxy(y, x).alias("_xy"),
    )
    own = stored(own, "lines")
    k = F.col("_k")
    mean = own.agg((F.sum(k * F.col("_x")) / F.sum(k)).alias("_mx"), (F.sum(k * F.col("_y")) / F.sum(k)).alias("_my"))
    dx, dy = F.col("_x") - F.col("_mx"), F.col("_y") - F.col("_my")
    line = own.crossJoin(F.broadcast(mean)).agg(F.try_divide(F.sum(F.col("_xy") + k * dx * dy), F.sum(F.col("_xx") + k * dx * dx)).alias("_pb"), F.max("_mx").alias("_px"), F.max("_my").alias("_py"))
    few = (F.col("n") < least) | F.col("_b").isNull()
    d = own.crossJoin(F.broadcast(line))  # one row
    return d.select(*by, "n", F.when(few, F.col("_pb")).otherwise(F.col("_b")).alias("slope"), F.when(few, F.col("_py") - F.col("_pb") * F.col("_px")).otherwise(F.col("_a")).alias("intercept"), F.when(~few, F.col("r2")).alias("r2"))


def shrunk_residual(df: DataFrame, by: str, residual: str, k: float) -> DataFrame:
    """Mean residual of an entity shrunk by n / (n + k)."""
    n = F.count(residual)
    return df.groupBy(by).agg((F.avg(residual) * n / (n + k)).alias("shrunk"), n.alias("n"))


def leave_one_out(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """RMSE of each group under the line fitted without it, from sums alone."""
    sums = {"n": F.lit(1.0), "x": F.col(x), "y": F.col(y), "xx": F.col(x) * F.col(x), "xy": F.col(x) * F.col(y), "yy": F.col(y) * F.col(y)}
    own = stored(df.groupBy(group).agg(*[F.sum(c).alias(k) for k, c in sums.items()]), "sums")
    total = own.agg(*[F.sum(k).alias(f"_{k}") for k in sums])
    own = own.crossJoin(F.broadcast(total))  # one row
    o = {k: F.col(f"_{k}") - F.col(k) for k in sums}
    d = o["n"] * o["xx"] - o["x"] * o["x"]
    b = F.try_divide(o["n"] * o["xy"] - o["x"] * o["y"], d)
    a = (o["y"] - b * o["x"]) / o["n"]
    sse = F.col("yy") - 2 * a * F.col("y") - 2 * b * F.col("xy") + F.col("n") * a * a + 2 * a * b * F.col("x") + b * b * F.col("xx")
    return own.filter(o["n"] > 2).select(group, F.sqrt(F.greatest(sse / F.col("n"), F.lit(0.0))).alias("rmse"), b.alias("slope"))


def two_regressors(df: DataFrame, by: list[str], y: str, x1: str, x2: str) -> DataFrame:
    """Slopes on two regressors by Cramer's rule over centred sums."""
    c = {k: F.covar_pop(a, b) for k, a, b in (("11", x1, x1), ("22", x2, x2), ("12", x1, x2), ("1y", x1, y), ("2y", x2, y))}
    g = df.groupBy(*by).agg(*[v.alias(f"c{k}") for k, v in c.items()], F.count(F.lit(1)).alias("n"))
    det = F.col("c11") * F.col("c22") - F.col("c12") * F.col("c12")
    return g.select(*by, "n", F.try_divide(F.col("c1y") * F.col("c22") - F.col("c2y") * F.col("c12"), det).alias("beta1"), F.try_divide(F.col("c2y") * F.col("c11") - F.col("c1y") * F.col("c12"), det).alias("beta2"))


def prediction_interval(df: DataFrame, by: str, x: str, y: str, at: float, t: float) -> DataFrame:
    """Line through an entity's frames, and its prediction interval at ``at``."""
    n, sxx = F.regr_count(y, x), F.regr_sxx(y, x)
    sse = F.regr_syy(y, x) - F.regr_slope(y, x) * F.regr_sxy(y, x)
    half = t * F.sqrt(F.greatest(sse, F.lit(0.0)) / (n - 2) * (1 + 1 / n + F.pow(F.lit(at) - F.regr_avgx(y, x), 2) / sxx))
    g = df.groupBy(by).agg((F.regr_intercept(y, x) + F.regr_slope(y, x) * at).alias("level"), F.when(n > 2, half).alias("half_width"), n.alias("n"))
    return g.filter("n > 2")


def path_offset(df: DataFrame, by: str, a: str, b: str, least: int) -> DataFrame:
    """Half of the median difference of two overlapping paths goes to each; too small an overlap gives no offset."""
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    return both.groupBy(by).agg(F.when(F.count(F.lit(1)) >= least, F.percentile(F.col(a) - F.col(b), F.lit(0.5)) / 2).alias("offset"), F.count(F.lit(1)).alias("overlap"))


def gram(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long-form Gram matrix of centred columns: the input of a partial OLS."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    g = df.agg(*[F.covar_pop(a, b).alias(f"{a}__{b}") for a, b in pairs])
    entries = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}__{b}").alias("cov")) for a, b in pairs])
    return g.select(F.inline(entries))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve from average ranks.

    Ranks come from counts per distinct score, so a tie is one row; the running
    sum runs over ranges of scores (``order.running``), not in one task.
    """
    g = df.groupBy(F.col(score).alias("_s")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("_p"), F.count(F.lit(1)).alias("_n"))
    r = order.running(g, [], ["_s"], F.col("_n"), "_before").withColumn("_rank", F.col("_before") + (F.col("_n") + 1) / 2)
    s = r.agg(F.sum(F.col("_rank") * F.col("_p")).alias("rp"), F.sum("_p").alias("p"), F.sum("_n").alias("n"))
    p, n = F.col("p"), F.col("n") - F.col("p")
    return s.select(F.try_divide(F.col("rp") - p * (p + 1) / 2, (p * n).cast("double")).alias("auc"), p.alias("n_positive"), n.alias("n_negative"))


def average_rank(df: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """Rank within the group, ties sharing their mean; null for null."""
    r = order.ranks(df, [by], value).select(F.col(by).alias("_g"), F.col(value).alias("_v"), (F.col("below") + (F.col("equal") + 1) / 2).alias(name))
    return df.join(r, F.col(by).eqNullSafe(F.col("_g")) & (F.col(value) == F.col("_v")), "left").drop("_g", "_v")


def spearman(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    d = average_rank(average_rank(stored(df.select(by, x, y), "pairs"), by, x, "_rx"), by, y, "_ry")
    return d.groupBy(by).agg(F.corr("_rx", "_ry").alias("rho"), F.count(F.lit(1)).alias("n"))


def hinge(df: DataFrame, candidates: list[float], x: str, y: str, w: str) -> DataFrame:
    """Weighted SSE of y = a + b x + c max(0, x - k) for each candidate knot k, one pass over (row, candidate)."""
    d = df.withColumn("knot", F.explode(F.array(*[F.lit(float(k)) for k in candidates])))
    h = F.greatest(F.lit(0.0), F.col(x) - F.col("knot"))
    sw = F.sum(w)
    mean = lambda c: F.sum(F.col(w) * c) / sw
    cov = lambda a, b: mean(a * b) - mean(a) * mean(b)
    g = d.groupBy("knot").agg(cov(F.col(x), F.col(x)).alias("xx"), cov(h, h).alias("hh"), cov(F.col(x), h).alias("xh"), cov(F.col(x), F.col(y)).alias("xy"), cov(h, F.col(y)).alias("hy"), cov(F.col(y), F.col(y)).alias("yy"), sw.alias("sw"))
    det = F.col("xx") * F.col("hh") - F.col("xh") * F.col("xh")
    b = F.try_divide(F.col("xy") * F.col("hh") - F.col("hy") * F.col("xh"), det)
    c = F.try_divide(F.col("hy") * F.col("xx") - F.col("xy") * F.col("xh"), det)
    sse = F.col("sw") * (F.col("yy") - b * F.col("xy") - c * F.col("hy"))
    return g.select("knot", b.alias("slope"), c.alias("bend"), sse.alias("sse"))


def decile_errors(df: DataFrame, edges: list[float], di: str, residual: str, w: str, least: int) -> DataFrame:
    """Weighted RMSE and absolute error quantiles for each class of the dissimilarity index."""
    e = F.array(*[F.lit(float(x)) for x in edges])
    k = F.size(F.filter(e, lambda x: x <= F.col(di)))
    g = df.groupBy(k.alias("decile")).agg(F.sqrt(F.sum(F.col(w) * F.col(residual) * F.col(residual)) / F.sum(w)).alias("rmse"), F.percentile(F.abs(F.col(residual)), F.lit(0.9)).alias("q90"), F.count(F.lit(1)).alias("n"))
    return g.filter(F.col("n") >= least)
