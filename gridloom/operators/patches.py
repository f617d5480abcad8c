"""8-connected patches of a lattice by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stored
from .spatial import lattice_pairs


def patches(cells: DataFrame, cls: str, rounds: int = 100) -> DataFrame:
    """cell_id, class, patch (the smallest cell_id of the patch).

    Each round takes the least label of a cell's neighbours and then the label
    of that label, so a patch of n cells settles in about log n rounds. Joins merge,
    so that labels never pass through the driver.
    """
    pairs = lattice_pairs(cells, 1, ["cell_id", cls]).filter(F.col(cls) == F.col(f"{cls}_b"))
    edges = stored(pairs.select("cell_id", F.col("cell_id_b").alias("near")), "edges")
    label = stored(cells.select("cell_id", cls, F.col("cell_id").alias("patch")), "labels")
    for _ in range(rounds):
        near = edges.join(label.select(F.col("cell_id").alias("near"), F.col("patch").alias("p")).hint("merge"), "near").groupBy("cell_id").agg(F.min("p").alias("p"))
        low = label.join(near.hint("merge"), "cell_id", "left").select("cell_id", cls, F.least("patch", "p").alias("q"), F.col("patch").alias("old"))
        jump = low.select(F.col("cell_id").alias("q"), F.col("q").alias("r"))
        new = stored(low.join(jump.hint("merge"), "q", "left").select("cell_id", cls, F.least("q", "r").alias("patch"), (F.least("q", "r") < F.col("old")).alias("moved")), "labels")
        label = new.drop("moved")
        if not new.filter("moved").limit(1).count():
            return label
    raise RuntimeError("patches did not settle")
