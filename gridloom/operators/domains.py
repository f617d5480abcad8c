"""Display domains of fields and changes, and values of a series at a year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import order
from .windows import nearest_rank

#: The least half-width of a symmetric domain, and the share of changes inside it.
LEAST_BOUND, SHARE = 0.05, 0.98


def delta_domain(values: DataFrame, by: str, cell: str, frame: str, value: str, reference: int) -> DataFrame:
    """by, bound, n: the value at rank floor(0.98 (n - 1)) of all absolute differences from a cell's reference frame.

    The reference frame itself and cells without a finite value there take no part; a
    group in which nothing differs has no scale and no row. All cells count, none are sampled.
    """
    v = values.select(F.col(by).alias("_g"), F.col(cell).alias("_c"), F.col(frame).alias("_f"), order.finite(F.col(value).cast("double")).alias("_v")).filter("_v is not null")
    ref = v.filter(F.col("_f") == reference).select("_g", "_c", F.col("_v").alias("_r"))
    d = v.filter(F.col("_f") != reference).join(ref, ["_g", "_c"]).select("_g", F.abs(F.col("_v") - F.col("_r")).alias("_d"))
    n = d.groupBy("_g").agg(F.count(F.lit(1)).alias("n"))
    b = nearest_rank(d, "_g", "_d", SHARE).filter("quantile > 0")
    return b.join(n, "_g").select(F.col("_g").alias(by), F.col("quantile").alias("bound"), "n")


def _pair(a: Column, b: Column) -> Column:
    return order.finite(a).isNotNull() & order.finite(b).isNotNull()


def symmetric_bound(p02: Column, p98: Column, low: Column, high: Column) -> Column:
    """The larger magnitude of the tails that are there, else of the extremes; at least 0.05."""
    larger = lambda a, b: F.greatest(F.abs(order.finite(a)), F.abs(order.finite(b)))  # noqa: E731  nulls are passed over
    return F.greatest(F.coalesce(larger(p02, p98), larger(low, high), F.lit(0.0)), F.lit(LEAST_BOUND))


def sequential_domain(p02: Column, p98: Column, low: Column, high: Column) -> Column:
    """[p02, p98] if it is a range, else [low, high], else [0, 1]."""
    return F.when(_pair(p02, p98) & (p98 > p02), F.array(p02, p98)).when(_pair(low, high) & (high > low), F.array(low, high)).otherwise(F.array(F.lit(0.0), F.lit(1.0)))


def metric_at(asked: DataFrame, observed: DataFrame, projected: DataFrame, metrics: list[str]) -> DataFrame:
    """``asked`` (scope, year, metric, ssp) with ``kind`` and ``value``.

    An observed frame answers with its own column (``dtr`` is its mean), a projected one with the p50 of the
    scenario, for the mean only; what is not there is null. ``observed`` holds scope, year and ``metrics``;
    ``projected`` scope, year, ssp and p50; a year that both have is observed.
    """
    o = observed.select(F.col("scope").alias("_s"), F.col("year").alias("_y"), *[F.col(m).alias(f"_m_{m}") for m in metrics])
    p = projected.select(F.col("scope").alias("_ps"), F.col("year").alias("_py"), F.col("ssp").alias("_pssp"), "p50")
    want = F.when(F.col("metric") == "dtr", "mean").otherwise(F.col("metric"))
    own = F.coalesce(*[F.when(want == m, order.finite(F.col(f"_m_{m}"))) for m in metrics])
    a = asked.select("scope", "year", "metric", "ssp")
    j = a.join(o, (a["scope"] == o["_s"]) & (a["year"] == o["_y"]), "left").join(p, (a["scope"] == p["_ps"]) & (a["year"] == p["_py"]) & (a["ssp"] == p["_pssp"]), "left")
    kind = F.when(F.col("_s").isNotNull(), "observed").when(F.col("_ps").isNotNull(), "projected")
    value = F.when(kind == "observed", own).when((kind == "projected") & (F.col("metric") == "mean"), order.finite(F.col("p50")))
    return j.select("scope", "year", "metric", "ssp", kind.alias("kind"), value.alias("value"))
