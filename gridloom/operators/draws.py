"""Monte-Carlo draws with a counter-based generator and block-correlated errors.

A draw is a function of its seed and counters (cell or block, draw number), so
it needs no state: any task computes any draw, again after a loss too, and other
engines compute the same ones. Model error follows a one-factor copula: cells of
a block share a normal factor with weight sqrt(rho), each has its own with
sqrt(1 - rho), and the sum's probability picks from the sorted residuals of the
cell's error class. A cell's draws are one array; per scope they are averaged
draw by draw, which keeps what blocks and shared parameters have in common.

The functions on columns and those on Arrow batches are the same; a batch of
cells makes all its draws at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import let
from .moran import mixed

#: The rational approximation of the normal distribution function with an error below 1e-7.
SLOPE, TERMS = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def uniform(seed: int, stream: int, of: Column, draw: Column) -> Column:
    """In (0, 1), for whole numbers ``of`` and ``draw`` from 0."""
    return let(mixed(F.lit(seed * 16 + stream).cast("long"), of.cast("long")), lambda h: (mixed(h, draw.cast("long")) + 0.5) / 2147483647.0)


def normal(seed: int, stream: int, of: Column, draw: Column) -> Column:
    """Standard normal from two uniforms of neighbouring streams."""
    return F.sqrt(-2 * F.log(uniform(seed, stream, of, draw))) * F.cos(2 * math.pi * uniform(seed, stream + 1, of, draw))


def probability(z: Column) -> Column:
    """The normal distribution function."""

    def tail(z: Column) -> Column:
        t = F.array(1 / (1 + SLOPE * F.abs(z)))
        series = F.transform(t, lambda t: sum((c * F.pow(t, F.lit(float(k))) for k, c in enumerate(TERMS, 1)), F.lit(0.0)))
        return F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * F.get(series, F.lit(0))

    return let(z, lambda z: let(tail(z), lambda q: F.when(z < 0, q).otherwise(1 - q)))


def pick(values: Column, u: Column) -> Column:
    """The element of an array at probability ``u``; null for an empty or null array."""
    n = F.size(values)
    return F.when(n > 0, F.get(values, F.least(F.floor(u * n), n - 1).cast("int")))


def _mixed(a, b):
    """As ``mixed``, on whole arrays."""
    return (a * 73856093 + b * 19349663) % 2147483647 * ((a * 83492791 + b * 2654435) % 1000003 + 1) % 2147483647


def _uniform(seed: int, stream: int, of: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """of x draws."""
    return (_mixed(_mixed(np.int64(seed * 16 + stream), of)[:, None], draw[None]) + 0.5) / 2147483647.0


def normals(seed: int, stream: int, of: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """As ``normal``: of x draws."""
    return np.sqrt(-2 * np.log(_uniform(seed, stream, of, draw))) * np.cos(2 * math.pi * _uniform(seed, stream + 1, of, draw))


def _probability(z: np.ndarray) -> np.ndarray:
    t = 1 / (1 + SLOPE * np.abs(z))
    tail = np.exp(-z * z / 2) / math.sqrt(2 * math.pi) * sum(c * t**k for k, c in enumerate(TERMS, 1))
    return np.where(z < 0, tail, 1 - tail)


def _errors(cell: np.ndarray, block: np.ndarray, residuals: pa.ListArray, rho: float, draw: np.ndarray, seed: int) -> np.ndarray:
    """cells x draws: each from its cell's sorted residuals; zero where it has none."""
    z = math.sqrt(1 - rho) * normals(seed, 2, cell, draw)
    blocks, at = np.unique(block, return_inverse=True)
    z += (math.sqrt(rho) * normals(seed, 0, blocks, draw))[at]
    n = pa.compute.fill_null(residuals.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)[:, None]
    pool = np.append(residuals.flatten().to_numpy(zero_copy_only=False).astype(float), 0.0)
    first = (np.cumsum(n) - n[:, 0])[:, None]
    return np.where(n > 0, pool[np.where(n > 0, first + np.minimum(np.floor(_probability(z) * n).astype(np.int64), n - 1), len(pool) - 1)], 0.0)


def project(df: DataFrame, keys: list[str], *, cell: Column, block: Column, residuals: Column, base: Column, pattern: Column, models: list[float], betas: list[float], rho: float, draws: int, seed: int) -> DataFrame:
    """keys, draws: base + pattern * (a model's change) * (a sensitivity) + error for each draw 1..``draws``.

    Which model and sensitivity a draw takes is the same for all cells; ``cell``
    and ``block`` are whole numbers from 0, ``residuals`` a sorted array of the
    cell's error class (none: no error). Rows stay where they are.
    """
    n, draw = len(keys), np.arange(1, draws + 1, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = [np.array(x, float)[np.minimum((_uniform(seed, stream, np.zeros(1, np.int64), draw)[0] * len(x)).astype(np.int64), len(x) - 1)] for stream, x in ((4, models), (5, betas))]
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                b = batch.slice(at, 2048)
                cell, block, base, pattern = (b.column(n + i).to_numpy(zero_copy_only=False) for i in range(4))
                x = base[:, None] + pattern[:, None] * (taken[0] * taken[1])[None] + _errors(cell, block, b.column(n + 4), rho, draw, seed)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * draws), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns[:n], lists], names=[*keys, "draws"])

    rows = df.select(*keys, cell.cast("long").alias("_c"), block.cast("long").alias("_b"), base.cast("double").alias("_x"), pattern.cast("double").alias("_p"), residuals.alias("_r"))
    return rows.mapInArrow(run, ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", draws array<double>")


def array_quantile(values: Column, p: float) -> Column:
    """Interpolated quantile of an array without nulls."""
    s = F.sort_array(values)
    h = p * (F.size(values) - 1)
    lo, hi = F.get(s, F.floor(h).cast("int")), F.get(s, F.ceil(h).cast("int"))
    return lo + (hi - lo) * (h - F.floor(h))


def scope_draws(df: DataFrame, scope: str) -> DataFrame:
    """scope, draw, mean: averages of each draw over a scope's cells; they combine before the shuffle."""
    d = df.select(scope, F.posexplode("draws").alias("draw", "x"))
    return d.groupBy(scope, "draw").agg(F.avg("x").alias("mean"))
