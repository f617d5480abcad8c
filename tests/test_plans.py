"""Joins of tables that grow are not sent through the driver."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from gridloom.operators import grid, moran, patches, scenario, spatial
from gridloom.plans import registry


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as text:
        df.explain()
    return text.getvalue()


@pytest.fixture(scope="module")
def cells(spark):
    return spark.range(60).selectExpr("id AS cell_id", "id div 10 AS row", "id % 10 AS col", "CAST(id % 3 AS string) AS cls", "CAST(id * 7 % 11 AS double) AS v")


def test_neighbours_merge(cells):
    assert "BroadcastHashJoin" not in plan(spatial.lattice_pairs(cells, 2, ["cell_id"]))
    assert "BroadcastHashJoin" not in plan(spatial.knn(cells, "cell_id", 8, 2))


def test_values_of_morans_i_merge(cells):
    assert "BroadcastHashJoin" not in plan(spatial.morans_i(cells, spatial.lattice_pairs(cells, 1, ["cell_id"]), "cell_id", "v"))


def test_permuted_values_merge(cells):
    d = moran.moran_test(cells, spatial.lattice_pairs(cells, 1, ["cell_id"]), "cell_id", "v", 9)
    assert "BroadcastHashJoin" not in plan(d)


def test_labels_of_patches_merge(cells, monkeypatch):
    seen, stored = [], patches.stored
    monkeypatch.setattr(patches, "stored", lambda df, name: (seen.append(plan(df)), stored(df, name))[1])
    assert patches.patches(cells.select("cell_id", "row", "col", "cls"), "cls").count() == 60
    assert len(seen) > 2 and not any("BroadcastHashJoin" in p for p in seen)


def test_running_frames_only_grow(cells):
    """A frame from the current row to the end is summed anew for every row."""
    d = cells.selectExpr("cell_id", "cls", "v AS cap", "v + 1 AS a", "60D AS demand")
    assert "currentrow$(), unboundedfollowing$()" not in plan(scenario.allocate(d, "cls", "cap", "a", "demand"))


def test_distance_by_frames_that_only_grow(cells):
    text = plan(grid.distance(cells, F.col("v") > 5))
    assert "currentrow$(), unboundedfollowing$()" not in text and "BroadcastHashJoin" not in text


def test_a_located_point_stays_one_row(spark, sf):
    text = plan(registry.queries()["q_cell_locator"](spark, sf))
    assert "min_by" not in text and "BroadcastHashJoin" not in text
