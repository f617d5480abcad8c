"""Levels of frames without observations, from a regression on annual series.

An entity's annual observed series is regressed on a driver known for every year;
a frame is the mean of its window's years. What observed frames differ from the
line on average is the offset of the frames' mask, and a drift of the residuals
over the primary source's years is carried on where it is long and clear enough.
Everything is a sum by entity or an equi-join on (entity, year).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import finite
from .scratch import stored

#: 95 % quantiles of Student's t for 1 to 30 degrees of freedom, and of the normal distribution.
T95 = (
    6.313752, 2.919986, 2.353363, 2.131847, 2.015048, 1.943180, 1.894579, 1.859548, 1.833113, 1.812461, 1.795885, 1.782288, 1.770933, 1.761310, 1.753050,
    1.745884, 1.739607, 1.734064, 1.729133, 1.724718, 1.720743, 1.717144, 1.713872, 1.710882, 1.708141, 1.705618, 1.703288, 1.701131, 1.699127, 1.697261,
)
Z95 = 1.6448536269514722
#: Years a regression needs, and the half-width of a level without one.
LEAST_YEARS, FALLBACK = 5, 1.5


def student95(df: Column) -> Column:
    """95 % quantile of Student's t: the table, and two terms of its expansion in 1 / df beyond."""
    z = Z95
    far = z + (z**3 + z) / (4 * df) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * df * df)
    return F.when(df <= len(T95), F.get(F.array(*[F.lit(t) for t in T95]), df.cast("int") - 1)).otherwise(far)


def modelled_levels(annual: DataFrame, frames: DataFrame, by: str, drift_years: int) -> DataFrame:
    """by, frame, tier, level, half_width, years, drift, predicted, error, method.

    ``annual``: by, year, x, y, primary (bool); ``frames``: by, frame, first, last, tier, level, half_width,
    with null levels for tier ``modelled``. The half-width is that of a 90 % prediction
    interval of a new window mean: error of the mean, of the line, of the offset and of drift.
    The drift applies if it exceeds two standard errors over at least ``drift_years``
    primary years that span as many. Without a line or driver a modelled frame takes the mean
    of the observed ones, 1.5 to either side. Years lacking x or y are no part of the line.
    """
    a = stored(annual.select(F.col(by).alias("_g"), F.col("year").cast("long").alias("year"), finite(F.col("x").cast("double")).alias("x"), finite(F.col("y").cast("double")).alias("y"), "primary"), "annual")
    pairs = a.filter("x is not null and y is not null")
    line = pairs.groupBy("_g").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("year").alias("my_"), F.regr_sxx("y", "x").alias("sxx"), F.regr_sxy("y", "x").alias("sxy"), F.regr_syy("y", "x").alias("syy"), F.regr_sxx("y", "year").alias("stt"),
    )
    line = line.filter(F.col("n") >= LEAST_YEARS).withColumn("b", F.coalesce(F.try_divide("sxy", "sxx"), F.lit(0.0)))
    line = line.withColumn("s2", F.greatest(F.lit(0.0), F.col("syy") - F.col("b") * F.col("sxy")) / (F.col("n") - 2))

    r = pairs.filter("primary").join(line.select("_g", "mx", "my", "b"), "_g").withColumn("e", F.col("y") - F.col("my") - F.col("b") * (F.col("x") - F.col("mx")))
    d = r.groupBy("_g").agg(F.count(F.lit(1)).alias("k"), (F.max("year") - F.min("year")).alias("span"), F.regr_slope("e", "year").alias("slope"), F.regr_sxx("e", "year").alias("tt"), F.regr_sxy("e", "year").alias("te"), F.regr_syy("e", "year").alias("ee"))
    se = F.sqrt(F.try_divide(F.greatest(F.lit(0.0), F.col("ee") - F.col("slope") * F.col("te")), (F.col("k") - 2) * F.col("tt")))
    clear = (F.col("k") >= 4) & (F.col("k") >= drift_years) & (F.col("span") >= drift_years) & (F.abs("slope") > 2 * se)
    line = line.join(d.select("_g", F.when(clear, F.col("slope")).otherwise(0.0).alias("drift")), "_g", "left").withColumn("drift", F.coalesce("drift", F.lit(0.0)))

    f = frames.select(F.col(by).alias("_g"), "frame", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "tier", finite(F.col("level").cast("double")).alias("own"), finite(F.col("half_width").cast("double")).alias("own_half"))
    f = f.withColumn("t", (F.col("first") + F.col("last")) / 2)
    spans = f.select("_g", "frame", F.explode(F.sequence("first", "last")).alias("year")).join(a.filter("x is not null").select("_g", "year", "x"), ["_g", "year"])
    window = spans.groupBy("_g", "frame").agg(F.avg("x").alias("at"), F.count(F.lit(1)).alias("years"))
    f = stored(f.join(window, ["_g", "frame"], "left").join(line, "_g", "left").withColumn("fit", F.col("my") + F.col("b") * (F.col("at") - F.col("mx"))), "frames")

    seen = f.filter((F.col("tier") != "modelled") & (F.col("tier") != "reconstructed") & F.col("own").isNotNull())
    off = seen.groupBy("_g").agg(
        F.avg("own").alias("mean_own"), F.avg(F.col("own") - F.col("fit")).alias("off"), F.avg(F.when(F.col("fit").isNotNull(), F.col("t"))).alias("t0"),
        F.count("fit").alias("m"), F.var_samp(F.col("own") - F.col("fit") - F.col("drift") * F.col("t")).alias("var"),
    )
    j = f.join(off, "_g", "left")
    drifted = F.col("drift") * (F.col("t") - F.coalesce("t0", F.lit(0.0)))
    spread = F.when(F.col("m") >= 2, F.col("var") * (1 + 1 / F.col("m"))).otherwise(0.0)
    lever = 1 / F.col("n") + F.coalesce(F.try_divide(F.pow(F.col("at") - F.col("mx"), 2), F.col("sxx")), F.lit(0.0))
    wander = F.pow(F.col("t") - F.col("my_"), 2) * F.try_divide("s2", "stt")
    half = student95(F.col("n") - 2) * F.sqrt(F.col("s2") / F.col("years") + F.col("s2") * lever + spread + wander)
    predicted = F.col("fit") + F.coalesce("off", F.lit(0.0)) + drifted
    j = j.withColumn("predicted", predicted).withColumn("reach", half)
    mine = F.col("tier") != "modelled"
    lined = F.col("predicted").isNotNull()
    return j.select(
        F.col("_g").alias(by), "frame", "tier",
        F.when(mine, F.col("own")).otherwise(F.coalesce("predicted", "mean_own")).alias("level"),
        F.when(mine, F.col("own_half")).when(lined, F.col("reach")).when(F.col("mean_own").isNotNull(), FALLBACK).alias("half_width"),
        F.coalesce("years", F.lit(0)).alias("years"), F.when(lined, drifted).alias("drift"), "predicted", F.when(mine, F.col("own") - F.col("predicted")).alias("error"),
        F.when(mine, "observed").when(lined, "regression").when(F.col("mean_own").isNotNull(), "mean of observed").otherwise("none").alias("method"),
    )
