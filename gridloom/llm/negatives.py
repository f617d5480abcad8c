"""Hard negatives for every anchor by a full sort of its integer scores.

Vectors become integers (``floor(scale * x)``) and a row's score is its inner
product with the anchor, so orders are exact. Anchors are a stated query set
and are compared with all rows, a bounded block of anchors at a time:

1. every task scores its rows against the block, sorts each anchor's scores
   (highest first, ties by smaller id) and passes on the first rows of the
   anchor's own label; their merge is the anchor's positives;
2. every task sorts again, keeps each anchor's rows of other labels in that
   order, finds a positive's upper limit in it by binary search and reads the
   next ``k`` entries that are not below the lower limit. The first ``k`` of all
   tasks' entries are the result.

A task holds a chunk of rows, the scores of some anchors with it and what it
passes on, whatever the table's size; only rows that may be in the result are
shuffled. Each block's result is written to the shared folder, so a lost
executor costs a part of one block.

Defined results: rows with a null id, label or vector, or a null or non-finite
component, take no part; of the rows of a repeated id the smallest (by label,
then vector) stands for all; only vectors of the anchor's length are compared;
equal scores go by id; positives are fewer where the label has fewer, and a
positive with no row between its limits has no result; scores beyond a 64-bit
integer are its limit; an empty table gives an empty result; other columns of
the input are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ann import _by_length
from .common import scratch_path, stored

LEAST, MOST = -(1 << 63), (1 << 63) - 1
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def finite(c: Column) -> Column:
    """Vectors without null or non-finite components."""
    return F.coalesce(F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x); doubles, which hold such integers exactly."""
    return np.floor(scale * x.astype(np.float64))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows as 64-bit integers."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if largest < 2**53:  # every partial sum is exact
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in r] for r in x], object).reshape(x.shape)
    return np.clip(whole(a) @ whole(b).T, LEAST, MOST).astype(np.int64)


class Anchors:
    """A block of anchors, by vector length."""

    def __init__(self, rows: list[tuple[int, int, list[float]]], scale: int):
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in sorted({len(v) for _, _, v in rows}):
            of = [r for r in rows if len(r[2]) == n]
            ids, labels = (np.array([r[i] for r in of], np.int64) for i in (0, 1))
            self.by_length[n] = (ids, labels, integers(np.array([r[2] for r in of], np.float64).reshape(len(of), n), scale))


def _sorted_scores(batches: Iterator[pa.RecordBatch], anchors: Anchors, scale: int, room: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For some anchors and rows at a time: anchor ids, anchor labels, and each anchor's row ids, labels and scores in full order."""
    for b in batches:
        ids, labels = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for at, x in _by_length(b.column(2)):
            if x.shape[1] not in anchors.by_length:
                continue
            mine, own, wanted = anchors.by_length[x.shape[1]]
            for lo in range(0, len(at), 1 << 14):
                part = at[lo : lo + (1 << 14)]
                by_id = np.argsort(ids[part], kind="stable")
                rows, part = integers(x[lo : lo + (1 << 14)][by_id], scale), part[by_id]
                step = max(1, room // len(part))
                for a in range(0, len(mine), step):
                    s = scores(wanted[a : a + step], rows)
                    order = np.lexsort((np.broadcast_to(np.arange(len(part)), s.shape), ~s), axis=1)  # ~s falls as s grows and cannot overflow
                    yield mine[a : a + step], own[a : a + step], ids[part][order], labels[part][order], np.take_along_axis(s, order, axis=1)


def _first(found: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """The first k of each key: columns are key columns, then id, then score."""
    *keys, ids, score = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((ids, ~score, *keys[::-1]))
    cols = [c[order] for c in (*keys, ids, score)]
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in cols[: len(keys)]], axis=0)
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return tuple(c[rank < k] for c in cols)


def _sent(found: list[tuple[np.ndarray, ...]], k: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in _first(found, k)], names=names)


def _positives(anchors, n: int, scale: int, room: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, ...]] = []
        for mine, own, ids, labels, s in _sorted_scores(batches, anchors.value, scale, room):
            same = (labels == own[:, None]) & (ids != mine[:, None])
            i, j = np.nonzero(same & (np.cumsum(same, axis=1) <= n))
            found.append((mine[i], ids[i, j], s[i, j]))
            if sum(len(f[0]) for f in found) > 1 << 20:
                found = [_first(found, n)]
        yield from _sent(found, n, ["anchor_id", "positive_id", "positive_score"])

    return run


def _negatives(anchors, positives, k: int, low: int, high: int, scale: int, room: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, ...]] = []
        for mine, own, ids, labels, s in _sorted_scores(batches, anchors.value, scale, room):
            for i, anchor in enumerate(mine):
                other = np.flatnonzero(labels[i] != own[i])
                falling = ~s[i][other]  # ascending
                for positive, p in positives.value.get(int(anchor), ()):
                    # low * p <= 100 * score <= high * p in whole numbers
                    most, least = high * p // 100, -(-low * p // 100)
                    if most < max(least, LEAST) or least > MOST:
                        continue
                    most, least = min(most, MOST), max(least, LEAST)
                    a = int(np.searchsorted(falling, ~most, "left"))
                    z = int(np.searchsorted(falling[a : a + k], ~least, "right")) + a
                    if z > a:
                        at = other[a:z]
                        found.append((np.full(z - a, anchor), np.full(z - a, positive), np.full(z - a, p), ids[i][at], s[i][at]))
            if sum(len(f[0]) for f in found) > 1 << 20:
                found = [_first(found, k)]
        yield from _sent(found, k, ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return run


def mine_hard_negatives(
    vectors: DataFrame,
    *,
    is_anchor: str = "vec_id % 100 = 0",
    positives: int = 5,
    k: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
    block: int = 2048,
    room: int = 1 << 21,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors``: vec_id, label, embedding. A positive is one of the anchor's
    first ``positives`` rows of its own label; its negatives are the first ``k``
    rows of other labels with ``low``% <= negative / positive score <= ``high``%.
    ``block`` anchors are held by a task, with about ``room`` scores.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("embedding")))
    if not rows.groupBy("vec_id").count().filter("count > 1").isEmpty():
        rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("r")).select("vec_id", "r.label", "r.embedding")
    rows = stored(rows, "vectors")
    asked = rows.filter(is_anchor)
    blocks = -(-asked.count() // block)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(blocks, 1))))
    where = scratch_path(spark, "negatives")
    spark.createDataFrame([], RESULT).write.parquet(where)
    for i in range(blocks):
        mine = [(r["vec_id"], r["label"], r["embedding"]) for r in asked.filter(F.col("block") == i).collect()]
        anchors = spark.sparkContext.broadcast(Anchors(mine, scale))
        near = rows.mapInArrow(_positives(anchors, positives, scale, room), "anchor_id long, positive_id long, positive_score long")
        w = Window.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id")
        of: dict[int, list[tuple[int, int]]] = {}
        for r in near.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= positives).collect():  # block * positives rows
            of.setdefault(r["anchor_id"], []).append((r["positive_id"], r["positive_score"]))
        found = rows.mapInArrow(_negatives(anchors, spark.sparkContext.broadcast(of), k, low, high, scale, room), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
        w = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id")
        found = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").write.mode("append").parquet(where)
    return spark.read.schema(RESULT).parquet(where)
