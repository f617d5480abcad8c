"""A what-if's footprint: only what an edit can reach is computed again.

Edited cells mark the tiles whose boxes can hold one of them; focal means are
recomputed there and nowhere else, and kept only where an edited cell lies in the
box, so that no rounding of a recompute leaks into untouched cells. The work
follows the edit, not the map.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stored
from .tiles import box_stats, tiled


def material(old: Column, new: Column, share: float = 1e-6) -> Column:
    """A change of more than ``share`` of the larger of 1 and the old value, or from or to missing."""
    return F.coalesce(F.abs(new - old) > share * F.greatest(F.lit(1.0), F.abs(old)), old.isNull() != new.isNull())


def footprint(features: DataFrame, edits: DataFrame, value: str, windows: tuple[int, ...], tile: int = 64) -> DataFrame:
    """row, col, value, value_m<w>, in_zone, spill: the new features of every cell that the model has to see again.

    ``features``: row, col, value and its focal means value_m<w>; ``edits``:
    row, col, value of the edited zone, each cell once; a null makes it missing.
    Such cells are those with a material change in any feature, and those of the
    zone with any change at all; ``spill`` marks those outside the zone. Cells
    without a row do not exist: edits of them are left out.
    """
    names = [f"{value}_m{w}" for w in windows]
    zone = edits.select("row", "col", F.col(value).cast("double").alias("_new"), F.lit(True).alias("_zone"))
    both = features.select("row", "col", F.col(value).cast("double").alias("_old"), *names).join(zone, ["row", "col"], "left")
    after = F.when(F.col("_zone"), F.col("_new")).otherwise(F.col("_old"))
    both = stored(both.withColumn("_after", after).withColumn("_edited", F.when(~F.col("_old").eqNullSafe(after), 1.0)), "edited")
    hit = both.filter("_edited = 1").select("row", "col")
    now = both.select("row", "col", "_old", F.col("_after").alias(value), F.coalesce("_zone", F.lit(False)).alias("in_zone"), *[F.col(n).alias(f"_{n}") for n in names])
    stacked = both.select("row", "col", F.explode(F.array(F.struct(F.lit("v").alias("kind"), F.col("_after").alias("x")), F.struct(F.lit("e").alias("kind"), F.col("_edited").alias("x")))).alias("s")).select("row", "col", "s.kind", "s.x")
    for w, name in zip(windows, names, strict=True):
        dirty = tiled(hit, tile, w // 2).select("tile_row", "tile_col").distinct()
        boxes = box_stats(stacked, "x", w, by=("kind",), tile=tile, only=dirty)
        new = boxes.groupBy("row", "col").agg(F.max(F.when(F.col("kind") == "v", F.col("mean"))).alias("_mean"), (F.max(F.when(F.col("kind") == "e", F.col("n"))) > 0).alias("_reached"))
        now = now.join(new, ["row", "col"], "left").withColumn(name, F.when(F.col("_reached"), F.col("_mean")).otherwise(F.col(f"_{name}"))).drop("_mean", "_reached")
    pairs = [(F.col("_old"), F.col(value)), *[(F.col(f"_{n}"), F.col(n)) for n in names]]
    any_of = lambda conditions: reduce(lambda a, b: a | b, conditions)
    seen = any_of([material(a, b) for a, b in pairs]) | (F.col("in_zone") & any_of([~a.eqNullSafe(b) for a, b in pairs]))
    return now.filter(seen).select("row", "col", value, *names, "in_zone", (~F.col("in_zone")).alias("spill"))


def zone_effect(features: DataFrame, changed: DataFrame, edits: DataFrame, old: Column, new: Column) -> DataFrame:
    """zone_mean, n_zone, spill_mean, n_spill of the change of a prediction: ``old`` on features, ``new`` on the changed cells; a cell that did not change counts as zero."""
    before = features.select("row", "col", old.alias("_p"))
    d = changed.select("row", "col", "spill", new.alias("_q")).join(before, ["row", "col"]).select("spill", (F.col("_q") - F.col("_p")).alias("d"))
    n = edits.join(features, ["row", "col"], "left_semi").agg(F.count(F.lit(1)).alias("n_zone"))
    s = d.agg(F.sum(F.when(~F.col("spill"), F.col("d"))).alias("z"), F.avg(F.when(F.col("spill"), F.col("d"))).alias("spill_mean"), F.count_if("spill").alias("n_spill"))
    return s.join(F.broadcast(n)).select(F.try_divide(F.coalesce("z", F.lit(0.0)), F.col("n_zone")).alias("zone_mean"), "n_zone", "spill_mean", "n_spill")
