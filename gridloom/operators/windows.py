"""Ordered analytics over frames: every one is a window partitioned by entity, so a frame axis never becomes one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import order


def rank_bump(df: DataFrame, frame: str, value: str, tie: str) -> DataFrame:
    """Rank within each frame, 1 = highest; nulls are not ranked."""
    w = Window.partitionBy(frame).orderBy(F.col(value).desc(), F.col(tie))
    return df.filter(F.col(value).isNotNull()).withColumn("rank", F.row_number().over(w))


def reference_anomaly(df: DataFrame, entity: str, frame: str, value: str, first: int, last: int) -> DataFrame:
    """Value minus the entity's mean over its reference frames; null without any."""
    ref = F.avg(F.when(F.col(frame).between(first, last), F.col(value))).over(Window.partitionBy(entity))
    return df.withColumn("anomaly", F.col(value) - ref)


def first_last_change(df: DataFrame, entity: str, frame: str, value: str) -> DataFrame:
    return df.groupBy(entity).agg(
        F.min(frame).alias("first_frame"),
        F.max(frame).alias("last_frame"),
        (F.max_by(value, frame) - F.min_by(value, frame)).alias("change"),
    )


def runs(df: DataFrame, entity: str, order: str, state: Column) -> DataFrame:
    """Gaps and islands: stretches of equal state."""
    w = Window.partitionBy(entity).orderBy(order)
    d = df.withColumn("state", state)
    d = d.withColumn("_new", F.when(F.col("state").eqNullSafe(F.lag("state").over(w)), 0).otherwise(1))
    d = d.withColumn("run", F.sum("_new").over(w).cast("long"))
    return d.groupBy(entity, "run", "state").agg(F.min(order).alias("first_frame"), F.max(order).alias("last_frame"), F.count(F.lit(1)).alias("n"))


def smooth3(df: DataFrame, entity: str, order: str, value: str) -> DataFrame:
    """Centred mean of three, shrinking at the ends; the sum of decimals is exact."""
    w = Window.partitionBy(entity).orderBy(order).rowsBetween(-1, 1)
    return df.withColumn("smooth", F.sum(value).over(w).cast("double") / F.count(value).over(w))


def zero_crossings(df: DataFrame, entity: str, x: str, y: str) -> DataFrame:
    """Places where y changes sign, by linear interpolation."""
    w = Window.partitionBy(entity).orderBy(x)
    d = df.withColumn("_x2", F.lead(x).over(w)).withColumn("_y2", F.lead(y).over(w))
    at = F.col(x) + (F.col("_x2") - F.col(x)) * (-F.col(y)) / (F.col("_y2") - F.col(y))
    return d.filter(F.col(y) * F.col("_y2") < 0).select(entity, at.alias("crossing"), (F.col("_y2") - F.col(y)).alias("jump"))


def theil_sen(df: DataFrame, entity: str, x: str, y: str) -> DataFrame:
    """Median of the slopes of all pairs of an entity's frames (a frame axis has tens of points, so pairs stay few)."""
    a, b = df.select(entity, F.col(x).alias("x1"), F.col(y).alias("y1")), df.select(F.col(entity).alias("_e"), F.col(x).alias("x2"), F.col(y).alias("y2"))
    pairs = a.join(b, (F.col(entity) == F.col("_e")) & (F.col("x1") < F.col("x2")))
    slope = (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))
    return pairs.groupBy(entity).agg(F.percentile(slope, F.lit(0.5)).alias("slope"), F.count(F.lit(1)).alias("pairs"))


def nearest_rank(df: DataFrame, by: str, value: str, q: float, how: str = "floor") -> DataFrame:
    """The value at rank floor or round of q * (n - 1), counted from 0; ranks come from counts of distinct values, range by range."""
    k = F.lit(q) * (F.col("n") - 1)
    k = F.floor(k) if how == "floor" else F.floor(k + 0.5)
    r = order.ranks(df, [by], value)
    return r.filter((F.col("below") <= k) & (k < F.col("below") + F.col("equal"))).select(by, F.col(value).alias("quantile"))


def interpolate(knots: DataFrame, points: DataFrame, by: str, x: str, y: str, geometric: bool = False) -> DataFrame:
    """Piecewise-linear (or geometric) lookup with flat tails.

    Knots and points of an entity are laid on one axis; the knots on both sides
    come from windows, so there is no range join.
    """
    k = knots.select(by, F.col(x).alias("_x"), F.col(y).alias("_y"), F.lit(0).alias("_point"))
    p = points.select(by, F.col(x).alias("_x"), F.lit(None).cast("double").alias("_y"), F.lit(1).alias("_point"))
    w = Window.partitionBy(by).orderBy("_x", "_point")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("_point") == 0, F.struct("_x", "_y"))
    d = k.union(p).withColumn("_a", F.last(known, ignorenulls=True).over(back)).withColumn("_b", F.first(known, ignorenulls=True).over(ahead))
    a, b = F.col("_a"), F.col("_b")
    m = (F.col("_x") - a["_x"]) / F.nullif(b["_x"] - a["_x"], F.lit(0))
    inner = F.pow(a["_y"], 1 - m) * F.pow(b["_y"], m) if geometric else a["_y"] + (b["_y"] - a["_y"]) * m
    value = F.when(a.isNull(), b["_y"]).when(b.isNull(), a["_y"]).otherwise(inner)
    return d.filter("_point = 1").select(by, F.col("_x").alias(x), value.alias(y))


def top_k(df: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark limits each partition before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= k)
