"""Exact nearest row of another group (fold) in a feature space, without comparing all pairs.

Space is cut into cells around a bounded number of pivots. The triangle
inequality bounds what a cell can hold: no row of cell c is nearer to a query
than max(d(query, pivot) - outermost, innermost - d(query, pivot)). Round one
looks into the nearest cell that holds another group, which gives every query a
real distance; round two looks into the cells whose bound is not above it, and
there only at rows in the ring between d(query, pivot) - best and + best.

* equal vectors are one row with its smallest ids of two different groups, which
  is all that any query can need, and a query for each of its groups: a third of
  all rows being copies costs one row;
* a cell of more than ``shard`` rows is dealt over several tasks, and its queries
  go to each of them; queries are streamed past a shard's rows;
* where most of a shard is in the ring, products in single precision, whose error is
  bounded, choose the few rows that are then measured in double precision;
* in many dimensions, where cells hardly keep apart, there are few of them and large
  shards, so that a row is sent to few places; many queries of one shard are several tasks;
* the driver sees the pivots and three numbers for each of them.

How much is pruned depends on the data: little in many near-independent
dimensions, nearly all on a few features. ``visited`` counts the rows that a
query was compared with.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored

ROOM = 1 << 20  # distances held at a time
TILE = 2048  # rows of a shard in one product
ASKED = 1 << 17  # about so many queries of a shard in a task, in many dimensions
MANY = 16  # dimensions beyond which cells hardly keep apart


def usable(v: Column) -> Column:
    """Vectors without null or non-finite components."""
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def weighted(v: Column, weights: Column) -> Column:
    """Components times weights (a feature importance each)."""
    return F.zip_with(v, weights, lambda x, w: x.cast("double") * w)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs, up to rounding."""
    return np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None] - 2 * a @ b.T, 0)


def _to_pivots(pivots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds each row's cell and its exact distance to the cell's pivot; the vector is the last column."""
        for b in batches:
            if b.num_rows:
                x, p = _matrix(b.columns[-1]), pivots.value
                step = max(1, ROOM // len(p))
                cell = np.concatenate([_squares(x[a : a + step], p).argmin(axis=1) for a in range(0, len(x), step)])
                radius = np.sqrt(((x - p[cell]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int64()), pa.array(radius)], names=[*b.schema.names, "cell", "radius"])

    return run


def _visits(pivots, cells, first: bool):
    """Rows of (group, best, v) -> the cells to look into: one that holds another group, or all others within the best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner, outer, only = cells.value
        for b in batches:
            step = max(1, ROOM // len(inner))
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                x, group = _matrix(part.column("v")), part.column("grp").to_numpy(zero_copy_only=False)
                d = np.sqrt(_squares(x, pivots.value))
                d = np.where((only[None] == group[:, None]) | (outer[None] < 0), np.inf, d)  # nothing of another group there
                if first:
                    near = d.argmin(axis=1)
                    i = np.flatnonzero(np.isfinite(d[np.arange(len(x)), near]))
                    j = near[i]
                else:
                    best, seen = part.column("best").to_numpy(zero_copy_only=False), part.column("seen").to_numpy(zero_copy_only=False)
                    bound = np.maximum(d - outer[None], inner[None] - d)
                    i, j = np.nonzero(np.isfinite(d) & (bound <= best[:, None] * (1 + 1e-9) + 1e-9 * (1 + d.min(axis=1))[:, None]) & (np.arange(len(inner))[None] != seen[:, None]))
                some = max(1, ROOM // x.shape[1]) if x.size else 1  # where little is pruned, a row goes to most cells
                for c in range(0, len(i), some):
                    q, k = i[c : c + some], j[c : c + some]
                    rows = part.take(pa.array(q)).select(["query", "grp", "best", "v"])
                    yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(np.sqrt(((x[q] - pivots.value[k]) ** 2).sum(axis=1))), *rows.columns], names=["cell", "radius", "query", "grp", "best", "v"])

    return run


class _Shard:
    """The rows of a shard, in order of their distance to the pivot."""

    def __init__(self, parts: list[pa.RecordBatch]):
        t = pa.Table.from_batches(parts).combine_chunks()
        radius = t["radius"].to_numpy()
        order = np.argsort(radius, kind="stable")
        self.radius, self.x = radius[order], _matrix(t["v"].combine_chunks())[order]
        self.ids, self.groups = (np.stack([t[f"{n}{k}"].to_numpy()[order] for k in (1, 2)], axis=1) for n in ("id", "grp"))
        # For products: around the mean, half the square of the length, and a mark for each group that is a row's only one.
        self.mean = self.x.mean(axis=0)
        y = self.x - self.mean
        self.unit = float(np.abs(y).max(initial=0)) or 1.0
        y /= self.unit
        half = (y**2).sum(axis=1) / 2
        self.length = math.sqrt(2 * half.max(initial=0))
        self.single = self.groups[:, 0] == self.groups[:, 1]
        self.kinds = np.unique(self.groups[self.single, 0])
        self.marked = len(self.kinds) <= 16
        marks = (self.groups[:, :1] == self.kinds[None]) & self.single[:, None] if self.marked else np.empty((len(y), 0))
        self.look = np.concatenate([y, -half[:, None], marks], axis=1).astype(np.float32)

    def nearest(self, x: np.ndarray, group: np.ndarray, radius: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, ...]:
        """distance, id (-1: none) and rows visited of each query."""
        out, ids, visited = np.full(len(x), np.inf), np.full(len(x), -1, np.int64), np.zeros(len(x), np.int64)
        slack = best * 1e-9 + 1e-9
        lo, hi = np.searchsorted(self.radius, radius - best - slack, "left"), np.searchsorted(self.radius, radius + best + slack, "right")
        p = (x - self.mean) / self.unit
        size = np.sqrt((p**2).sum(axis=1))
        reach = size * self.length + self.length**2
        # A product's error, and the product that a row as near as the best has; the nearest has the largest.
        error = (self.look.shape[1] + 8) * 2.0**-22 * reach + 1e-30
        with np.errstate(over="ignore", invalid="ignore"):
            aim = (size**2 - (best / self.unit) ** 2) / 2 - 1e-9 * (size**2 + (best / self.unit) ** 2)
        aim = np.maximum(np.where(np.isfinite(aim), aim, -np.inf), -2 * reach - 1)
        fine = (error <= 0.05 * self.length**2) & (reach < 1e30)
        if self.marked:
            marks = np.where(group[:, None] == self.kinds[None], -4 * reach[:, None] - 4, 0)
            sent = np.concatenate([p, np.ones((len(p), 1)), marks], axis=1)
        else:
            sent = np.concatenate([p, np.ones((len(p), 1))], axis=1)
        sent[~fine] = 0
        sent = sent.astype(np.float32)
        for these, products in ((np.flatnonzero(fine), True), (np.flatnonzero(~fine), False)):
            order = these[np.argsort(lo[these], kind="stable")]
            width = 256 if products and len(order) and 2 * np.median((hi - lo)[order]) > len(self.x) else 64
            at = 0
            while at < len(order):
                some = order[at : at + width]
                a, z = int(lo[some].min()), int(hi[some].max())
                while not products and len(some) > 1 and len(some) * (z - a) > ROOM:
                    some = some[: len(some) // 2]
                    a, z = int(lo[some].min()), int(hi[some].max())
                at += len(some)
                for c in range(a, z, TILE if products else ROOM):
                    if products:
                        self._choose(x, group, sent, aim, error, some, c, min(z, c + TILE), out, ids)
                    else:
                        self._look(x, group, some, c, min(z, c + ROOM), out, ids)
                visited[some] = z - a
        return out, ids, visited

    def _choose(self, x, group, sent, aim, error, some, a, z, out, ids) -> None:
        """Measures the rows from a to z whose products come up to the best so far."""
        score = sent[some] @ self.look[a:z].T
        if not self.marked:
            score[(self.groups[a:z, 0][None] == group[some][:, None]) & self.single[a:z][None]] = -np.inf
        top = score.max(axis=1)
        rows = np.flatnonzero(top >= aim[some] - 2 * error[some])
        if not len(rows):
            return
        q = some[rows]
        aim[q] = np.maximum(aim[q], top[rows])
        limit = np.nextafter((aim[q] - 2 * error[q]).astype(np.float32), np.float32(-np.inf))
        i, j = np.nonzero(score[rows] >= limit[:, None])
        if len(i) > max(ROOM // 16, 1) or len(i) * x.shape[1] > ROOM << 2:
            step = max(1, ROOM // (z - a))
            for c in range(0, len(q), step):
                self._look(x, group, q[c : c + step], a, z, out, ids)
            return
        i, j = q[i], a + j
        one, two = self.groups[j, 0] != group[i], self.groups[j, 1] != group[i]
        other = np.where(one, self.ids[j, 0], np.where(two, self.ids[j, 1], -1))
        valid = other >= 0
        self._keep(x, i[valid], j[valid], other[valid], out, ids)

    def _look(self, x, group, some, a, z, out, ids) -> None:
        own = group[some][:, None]
        one, two = self.groups[a:z, 0][None] != own, self.groups[a:z, 1][None] != own
        other = np.where(one, self.ids[a:z, 0][None], np.where(two, self.ids[a:z, 1][None], -1))
        d2 = np.where(other >= 0, _squares(x[some], self.x[a:z]), np.inf)
        least = d2.min(axis=1)
        size = (x[some] ** 2).sum(axis=1) + (self.x[a:z] ** 2).sum(axis=1).max()
        i, j = np.nonzero((d2 <= (least + 1e-9 * size)[:, None]) & (other >= 0))  # what may be nearest, measured exactly
        self._keep(x, some[i], a + j, other[i, j], out, ids)

    def _keep(self, x, q, row, other, out, ids) -> None:
        """Exact distances of pairs; the nearest of each query stays, ties to the smaller id."""
        d = np.sqrt(((x[q] - self.x[row]) ** 2).sum(axis=1))
        rank = np.lexsort((other, d, q))
        q, d, v = q[rank], d[rank], other[rank]
        new = np.ones(len(q), bool)
        new[1:] = q[1:] != q[:-1]
        q, d, v = q[new], d[new], v[new]
        better = (d < out[q]) | ((d == out[q]) & (v < ids[q]))
        out[q[better]], ids[q[better]] = d[better], v[better]


FOUND = "query long, distance double, neighbour long, visited long"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by place, a place's rows before its queries; queries stream past them."""
    now, parts, shard = None, [], None
    for b in batches:
        place, asks = b.column("place").to_numpy(), b.column("asks").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((np.diff(place) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1 if b.num_rows else []
        edges = [0, *[int(c) for c in cuts], b.num_rows]
        for a, z in zip(edges, edges[1:], strict=False):
            if a == z:
                continue
            if place[a] != now:
                now, parts, shard = place[a], [], None
            part = b.slice(a, z - a)
            if not asks[a]:
                parts.append(part)
                continue
            if not parts:
                continue
            shard = shard or _Shard(parts)
            got = shard.nearest(_matrix(part.column("v")), *(part.column(n).to_numpy(zero_copy_only=False) for n in ("grp1", "radius", "best")))
            yield pa.RecordBatch.from_arrays([part.column("id1"), *[pa.array(x) for x in got]], names=["query", "distance", "neighbour", "visited"])


def _dealt(sites: DataFrame, visits: DataFrame, shard: int, blocks: int) -> DataFrame:
    """Both sides at the places (cell, shard and block of queries) where they meet."""
    sizes = sites.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("shards"))
    here = sites.join(sizes, "cell").withColumn("s", F.pmod(F.xxhash64("v"), F.col("shards")).cast("int")).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    place = F.xxhash64("cell", "s", "r").alias("place")
    rows = here.select(place, F.lit(False).alias("asks"), "id1", "grp1", "id2", "grp2", "radius", F.lit(0.0).alias("best"), "v")
    sent = visits.join(sizes, "cell").withColumn("s", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).withColumn("r", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int"))
    asked = sent.select(place, F.lit(True).alias("asks"), F.col("query").alias("id1"), F.col("grp").alias("grp1"), F.lit(-1).cast("long").alias("id2"), F.col("grp").alias("grp2"), "radius", "best", "v")
    return rows.union(asked).repartition("place").sortWithinPartitions("place", "asks").mapInArrow(_meet, FOUND)


def pivot_count(n: int, dimensions: int) -> int:
    """In few dimensions cells keep apart: with their number a row visits fewer others. In many they do not, and each is one more place to go to."""
    return min(4096, max(64, 2 * math.isqrt(n))) if dimensions <= 8 else 64 if dimensions <= MANY else 16


def shard_size(dimensions: int) -> int:
    """In many dimensions a row goes to nearly all shards, so these are as large as a task holds easily."""
    return 8192 if dimensions <= MANY else min(65536, max(8192, (1 << 22) // dimensions))


def nearest_of_other_group(points: DataFrame, key: str, group: str, vector: str, *, pivots: int | None = None, shard: int | None = None) -> DataFrame:
    """key, distance, neighbour, visited: each row's nearest row of another group, ties to the smaller key.

    Keys are whole numbers from 0 and unique, groups whole numbers. Rows with a
    null key or group, or a vector that is null, not finite or shorter than the
    longest, take no part; without another group there is no result.
    ``pivots``: by default ``pivot_count`` of the rows; ``shard``: ``shard_size``.
    """
    spark = points.sparkSession
    rows = points.select(F.col(key).cast("long").alias("id"), F.col(group).cast("long").alias("grp"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    rows = stored(rows.filter(F.col("id").isNotNull() & F.col("grp").isNotNull() & usable(F.col("v"))), "points")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    rows = rows.filter(F.size("v") == size["d"])
    pivots, shard = pivots or pivot_count(size["n"], size["d"] or 0), shard or shard_size(size["d"] or 0)
    blocks = 1 + size["n"] // ASKED if (size["d"] or 0) > MANY else 1
    asked = stored(rows.groupBy("v", "grp").agg(F.min("id").alias("query")), "asked")
    w = Window.partitionBy("v").orderBy("query")
    two = asked.withColumn("n", F.row_number().over(w)).filter("n <= 2").groupBy("v")
    pick = lambda c, n: F.coalesce(F.max(F.when(F.col("n") == n, F.col(c))), F.lit(-1 if c == "query" else None).cast("long"))
    sites = two.agg(pick("query", 1).alias("id1"), pick("grp", 1).alias("grp1"), pick("query", 2).alias("id2"), F.coalesce(pick("grp", 2), pick("grp", 1)).alias("grp2"))
    chosen = [r["v"] for r in asked.select("v").distinct().orderBy(F.xxhash64("v")).limit(pivots).collect()]
    if not chosen:
        return rows.select(F.col("id").alias(key), F.lit(None).cast("double").alias("distance"), F.col("id").alias("neighbour"), F.col("id").alias("visited")).limit(0)
    axes = spark.sparkContext.broadcast(np.array(chosen, np.float64))
    sites = stored(sites.select("id1", "grp1", "id2", "grp2", "v").mapInArrow(_to_pivots(axes), "id1 long, grp1 long, id2 long, grp2 long, v array<double>, cell long, radius double"), "sites")
    of = sites.groupBy("cell").agg(F.min("radius").alias("inner"), F.max("radius").alias("outer"), F.min(F.least("grp1", "grp2")).alias("low"), F.max(F.greatest("grp1", "grp2")).alias("high"))
    inner, outer, only = np.full(len(chosen), np.inf), np.full(len(chosen), -1.0), np.full(len(chosen), np.nan)
    for r in of.collect():  # a row for each pivot
        inner[r["cell"]], outer[r["cell"]] = r["inner"], r["outer"]
        only[r["cell"]] = r["low"] if r["low"] == r["high"] else np.nan  # the cell's only group
    cells = spark.sparkContext.broadcast((inner, outer, only))
    visit = "cell long, radius double, query long, grp long, best double, v array<double>"
    one = asked.select("query", "grp", F.lit(float("inf")).alias("best"), "v").mapInArrow(_visits(axes, cells, True), visit)
    one = stored(one, "first")
    best = _dealt(sites, one, shard, blocks).groupBy("query").agg(F.min_by(F.struct("distance", "neighbour"), F.struct("distance", "neighbour")).alias("b"), F.sum("visited").alias("visited"))
    best = stored(best.filter("b.neighbour >= 0").select("query", "b.distance", "b.neighbour", "visited"), "best")
    more = one.select("query", F.col("cell").alias("seen"), "grp", "v").join(best, "query").select("query", "grp", F.col("distance").alias("best"), "seen", "v")
    rest = _dealt(sites, more.mapInArrow(_visits(axes, cells, False), visit), shard, blocks)
    both = best.unionByName(rest.filter("neighbour >= 0 or visited > 0"))
    key_of = F.struct("distance", F.when(F.col("neighbour") >= 0, F.col("neighbour")).otherwise((1 << 62)))
    final = both.groupBy("query").agg(F.min_by(F.struct("distance", "neighbour"), key_of).alias("b"), F.sum("visited").alias("visited"))
    answers = asked.join(final, "query").select("v", "grp", "b.distance", "b.neighbour", "visited")
    return rows.join(answers, ["v", "grp"]).select(F.col("id").alias(key), "distance", "neighbour", "visited")
