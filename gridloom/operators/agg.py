"""Aggregations over cubes: composites, coverage, weighted metrics, transitions.

Everything is a declarative groupBy with map-side partial aggregates; exact
percentiles are used where the definition asks for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import order
from .scratch import stored


def block_mean(df: DataFrame, parent: list[str], value: str, per_block: int, least_share: float) -> DataFrame:
    """Mean and count of the valid values of each block; null where too few are valid."""
    n = F.count(value)
    return df.groupBy(*parent).agg(F.when(n >= least_share * per_block, F.avg(value)).alias("mean"), n.alias("n"))


def block_std(df: DataFrame, parent: list[str], value: str) -> DataFrame:
    return df.groupBy(*parent).agg(F.when(F.count(value) > 1, F.stddev_pop(value)).alias("std"))


def median_composite(df: DataFrame, cell: list[str], day: Column, value: str, least: int) -> DataFrame:
    """First a mean for each day (one pass is one observation), then the median of days; null under ``least`` days."""
    days = df.groupBy(*cell, day.alias("_day")).agg(F.avg(value).alias("_v"))
    return days.groupBy(*cell).agg(F.when(F.count("_v") >= least, F.percentile("_v", F.lit(0.5))).alias("median"), F.count("_v").alias("n_days"))


def weighted_metrics(df: DataFrame, by: list[str], y: str, p: str, w: str, least: int = 2) -> DataFrame:
    """Weighted R2 (about the weighted mean), RMSE, MAE, bias and n in one pass."""
    sw, wy, wyy = F.sum(w), F.sum(F.col(w) * F.col(y)), F.sum(F.col(w) * F.col(y) * F.col(y))
    d = F.col(p) - F.col(y)
    sse = F.sum(F.col(w) * d * d)
    g = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.try_subtract(F.lit(1.0), F.try_divide(sse, wyy - wy * wy / sw)).alias("r2"),
        F.sqrt(sse / sw).alias("rmse"),
        (F.sum(F.col(w) * F.abs(d)) / sw).alias("mae"),
        (F.sum(F.col(w) * d) / sw).alias("bias"),
    )
    return g.filter(F.col("n") >= least)


def scope_bridge(df: DataFrame, scopes: dict[str, Column]) -> DataFrame:
    """One row for each scope a row belongs to; scopes whose expression is null are left out."""
    names = F.array(*[s for s in scopes.values()])
    return df.withColumn("scope", F.explode(F.filter(names, lambda s: s.isNotNull())))


def frame_stats(df: DataFrame, value: str, hot: float) -> DataFrame:
    """Mean, p90, count and share of hot cells for each scope and frame; a scope may hold all cells, so p90 is by selection."""
    df = stored(df.select("scope", "year", value), "scopes")
    rest = df.groupBy("scope", "year").agg(F.avg(value).alias("mean"), F.count(value).alias("n"), F.avg(F.when(F.col(value) >= hot, 1.0).otherwise(0.0)).alias("hot_share"))
    high = order.quantiles(df, ["scope", "year"], F.col(value), [0.9]).select("scope", "year", F.col("q")[0].alias("p90"))
    return rest.join(high, ["scope", "year"], "left")


def in_all_frames(df: DataFrame, cell: str, frame: str, valid: Column, frames: DataFrame) -> DataFrame:
    """Cells valid in every frame of ``frames`` (relational division)."""
    need = frames.select(F.count_distinct(frame).alias("need"))
    have = df.filter(valid).join(frames, frame, "left_semi").groupBy(cell).agg(F.count_distinct(frame).alias("have"))
    return have.filter(F.col("have") == need.scalar()).select(cell)


def transitions(df: DataFrame, entity: str, order: str, state: str) -> DataFrame:
    """Counts of state to next state, with row shares."""
    w = Window.partitionBy(entity).orderBy(order)
    pairs = df.withColumn("to_state", F.lead(state).over(w)).filter("to_state is not null")
    n = pairs.groupBy(F.col(state).alias("from_state"), "to_state").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("from_state")))


def mode_lowest(df: DataFrame, by: list[str], code: str) -> DataFrame:
    """The most frequent code of each group; ties go to the lowest."""
    n = df.groupBy(*by, code).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by).orderBy(F.col("_n").desc(), F.col(code))
    return n.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(*by, code, F.col("_n").alias("n"))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Counts over equal bins of the value range; a range under 1e-6 is widened by 0.05 on both sides."""
    r = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    if r["lo"] is None:
        return df.select(F.lit(0).cast("long").alias("bin"), F.lit(0.0).alias("left_edge"), F.lit(0).cast("long").alias("n")).limit(0)
    lo, hi = (r["lo"], r["hi"]) if r["hi"] - r["lo"] >= 1e-6 else (r["lo"] - 0.05, r["hi"] + 0.05)
    step = (hi - lo) / bins
    b = F.least(F.lit(bins - 1), F.floor((F.col(value) - lo) / step)).cast("long")
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n")).withColumn("left_edge", F.lit(lo) + F.col("bin") * step)
