"""Intervals of trends and sensitivities.

* ``theil_sen``: the median of all pairwise slopes and its interval without the
  pairs. A slope of given rank is found by closing in on it, where one count of
  inversions tells how many slopes lie below a value: n log n a step, and a task
  holds a series, not its pairs. Short series use their pairs, with equal results.
* ``block_bootstrap``: moving-block bootstrap of a fit on two regressors. Sums of
  a block are differences of prefix sums, so a replicate adds up a few of them and
  no row of the series is drawn; starts come from a counter-based generator.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .draws import array_quantile, uniform

SHORT = 512
DRAWN = 1 << 16  # pairs
MOVED = 2048  # rows of which all pairs are compared
#: Fixed value: the normal quantile of a two-sided 95 % interval.
Z95 = 1.959963984540054


def _by_value(r: np.ndarray) -> np.ndarray:
    """Places in order of value, of equal values the last first."""
    return len(r) - 1 - np.argsort(r[::-1], kind="stable")


def at_most(r: np.ndarray) -> int:
    """Pairs i < j with r[j] <= r[i]: inversions, equal values among them.

    Values become ranks, which are parted stably by one bit after the other, the highest first:
    an inversion is a one before a zero of the same part. A part's first place is its smallest rank.
    """
    n = len(r)
    v = np.arange(-(-n // 8) * 8, dtype=np.int64 if n >= 1 << 31 else np.int32)  # what fills up is in order
    v[_by_value(r)] = v[:n].copy()
    total = 0
    for k in range(max(n - 1, 0).bit_length() - 1, 2, -1):
        one = (v >> k) & 1
        start = v >> (k + 1) << (k + 1)
        ones = np.cumsum(one, dtype=v.dtype) - one
        ones -= ones[start]
        zero = one == 0
        total += int(ones[zero].sum(dtype=np.int64))
        to = np.where(zero, np.arange(len(v), dtype=v.dtype) - ones, start + (1 << k) + ones)
        parted = np.empty_like(v)
        parted[to] = v
        v = parted
    v = v.reshape(-1, 8)
    return total + sum(int(np.count_nonzero(v[:, :-d] > v[:, d:])) for d in range(1, 8))


def slopes_of_ranks(x: np.ndarray, y: np.ndarray, ranks: list[int], twins: int, pairs: int) -> dict[int, float]:
    """The slopes of the given ranks (from 0) of a series sorted by x, then y; ``twins`` pairs are equal in both, ``pairs`` differ in x.

    Exact counts bound each rank from both sides, and each is of use to all ranks. Slopes of
    drawn pairs say where to count first, then the counts themselves, until the rows that are left
    are few enough to compare all; halving makes sure of an end.
    """
    x = x - x[len(x) // 2]
    top = float(np.ptp(y) / np.diff(np.unique(x)).min()) + 1.0
    at, below = [-top, top], [0, pairs]  # numbers of slopes up to a value, both ascending

    def count(mid: float) -> None:
        k = bisect.bisect_left(at, mid)
        if at[k] != mid:
            n = at_most(y - mid * x) - twins
            at.insert(k, mid)
            below.insert(k, min(max(n, below[k - 1]), below[k]))

    rng = np.random.default_rng(len(x))
    i, j = rng.integers(0, len(x), (2, DRAWN))
    differ = x[i] != x[j]
    drawn = np.sort((y[j] - y[i])[differ] / (x[j] - x[i])[differ])
    for rank in ranks if len(drawn) else []:
        for off in (-2, 2):
            k = rank / pairs * len(drawn) + off * math.sqrt(len(drawn))
            count(min(max(float(drawn[int(min(max(k, 0), len(drawn) - 1))]), -top), top))

    def between(lo: float, hi: float) -> np.ndarray | None:
        """The slopes that are counted up to ``hi`` and not up to ``lo``, if few rows change places between the two."""
        old, new = _by_value(y - lo * x), _by_value(y - hi * x)
        place = np.empty(len(x), np.int64)
        place[new] = np.arange(len(x))
        last = np.maximum.accumulate(place[old])
        closed = last == np.arange(len(x))  # all up to here stay among themselves
        moved = ~(closed & np.concatenate([[True], closed[:-1]]))
        if np.count_nonzero(moved) > MOVED:
            return None
        rows = old[moved]
        a, b = np.nonzero(np.triu(rows[:, None] < rows[None], 1) & (place[rows][:, None] > place[rows][None]))
        a, b = rows[a], rows[b]
        return np.sort((y[b] - y[a]) / (x[b] - x[a]))

    def search(rank: int) -> float:
        turn, halve, tried = 0, False, 1 << 17
        while True:
            k = bisect.bisect_right(below, rank, 1, len(below) - 1)
            lo, hi, width = at[k - 1], at[k], below[k] - below[k - 1]
            mid = lo + (hi - lo) / 2
            if not lo < mid < hi or hi - lo <= 1e-15 * max(abs(lo), abs(hi)):
                return mid
            if 0 < width <= tried // 2:
                slopes, tried = between(lo, hi), width
                if slopes is not None:
                    return float(slopes[rank - below[k - 1]])
            if not halve and width > 16:  # a little below the rank, or above it
                aim = rank - below[k - 1] + (-1, 1)[turn % 2] * width**0.75
                guess = lo + (hi - lo) * min(max(aim / width, 0.01), 0.99)
                turn += 1
                mid = guess if lo < guess < hi else mid
            count(mid)
            k = bisect.bisect_right(below, rank, 1, len(below) - 1)
            halve = not halve and at[k] - at[k - 1] > (hi - lo) / 4

    return {rank: search(rank) for rank in ranks}


def _ties(v: np.ndarray) -> int:
    k = np.unique(v, return_counts=True)[1].astype(object)
    return int(sum(k * (k - 1) * (2 * k + 5)))


def _pairs_in_runs(cut: np.ndarray) -> int:
    """Pairs of rows in the same run of a sorted column; ``cut``: where the next row is another."""
    k = np.diff(np.concatenate([[-1], np.flatnonzero(cut), [len(cut)]]))
    return int((k * (k - 1) // 2).sum())


def theil_sen_of(x: np.ndarray, y: np.ndarray, least: int, short: int = SHORT) -> tuple[float, float, float] | None:
    """Median slope and its 95 % limits by Kendall's variance; None for under ``least`` values or one x alone."""
    n = len(x)
    if n < least or len(np.unique(x)) < 2:
        return None
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    new_x = np.diff(x) != 0
    pairs = n * (n - 1) // 2 - _pairs_in_runs(new_x)
    spread = Z95 * math.sqrt(max(n * (n - 1) * (2 * n + 5) - _ties(x) - _ties(y), 0) / 18)
    upper, lower = min(round((pairs + spread) / 2), pairs - 1), max(round((pairs - spread) / 2) - 1, 0)
    ranks = sorted({(pairs - 1) // 2, pairs // 2, lower, upper})
    if n <= short:
        i, j = np.triu_indices(n, 1)
        dx = x[j] - x[i]
        slopes = np.sort((y[j] - y[i])[dx > 0] / dx[dx > 0])
        of = {k: float(slopes[k]) for k in ranks}
    else:
        of = slopes_of_ranks(x, y, ranks, _pairs_in_runs(new_x | (np.diff(y) != 0)), pairs)
    return (of[(pairs - 1) // 2] + of[pairs // 2]) / 2, of[lower], of[upper]


def theil_sen(df: DataFrame, entity: str, x: str, y: str, least: int = 5, short: int = SHORT) -> DataFrame:
    """entity, slope, lo, hi, n of each series with at least ``least`` values; null, NaN and infinite values take no part."""
    kind = df.schema[entity].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        got = theil_sen_of(t["_x"].to_numpy(), t["_y"].to_numpy(), least, short)
        rows = [] if got is None else [(*got, t.num_rows)]
        cols = [pa.array([t["_e"][0].as_py()] * len(rows), t.schema.field("_e").type), *[pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.float64(),) * 3 + (pa.int64(),))]]
        return pa.table(cols, names=[entity, "slope", "lo", "hi", "n"])

    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = df.select(F.col(entity).alias("_e"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).filter(finite(F.col("_x")) & finite(F.col("_y")))
    # A number of its own, for else small tables are put into one task, however long their work takes.
    rows = rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_e")
    return rows.groupBy("_e").applyInArrow(run, f"`{entity}` {kind}, slope double, lo double, hi double, n long")


def _two_slopes(s: Column) -> Column:
    """Slope on the first regressor from the sums n, x1, x2, y, x1x1, x2x2, x1x2, x1y, x2y."""
    n, a, b, y, aa, bb, ab, ay, by = (F.element_at(s, i) for i in range(1, 10))
    caa, cbb, cab, cay, cby = aa - a * a / n, bb - b * b / n, ab - a * b / n, ay - a * y / n, by - b * y / n
    det = caa * cbb - cab * cab
    # What is left of a constant or collinear regressor is rounding.
    varies = (caa > 1e-9 * aa) & (cbb > 1e-9 * bb) & (det > 1e-9 * caa * cbb)
    return F.when(varies, (cay * cbb - cby * cab) / F.nullif(det, F.lit(0.0)))


def block_bootstrap(df: DataFrame, entity: str, order: str, y: str, x1: str, x2: str, *, block: int, draws: int, seed: int, least: int = 6) -> DataFrame:
    """entity, n, beta, lo, hi, used, fallback: the slope of y on x1 beside x2, and the 2.5 and 97.5 % points of ``draws`` moving-block replicates.

    ``entity`` is a whole number from 0. Rows with a null in any column take no
    part; ties of ``order`` go by the values. A series of under ``least`` rows,
    or whose regressors do not vary apart, has slope 1 and interval 0.5 to 1.5. Replicates whose
    regressors are collinear do not count (``used`` counts the others).
    """
    s = df.select(F.col(entity).cast("long").alias("e"), F.col(order).alias("o"), *[F.col(c).cast("double").alias(k) for c, k in ((x1, "a"), (x2, "b"), (y, "y"))]).dropna()
    means = s.groupBy("e").agg(F.count(F.lit(1)).alias("n"), *[F.avg(k).alias(f"m{k}") for k in "aby"], (F.max("a") > F.min("a")).alias("varies"))
    a, b, v = (F.col(k) - F.col(f"m{k}") for k in "aby")  # centred, so that prefix sums stay small
    c = s.join(means, "e")
    w = Window.partitionBy("e").orderBy("o", "a", "b", "y")
    parts = [F.lit(1.0), a, b, v, a * a, b * b, a * b, a * v, b * v]
    prefix = c.select("e", F.row_number().over(w).cast("long").alias("i"), F.array(*[F.sum(p).over(w.rowsBetween(Window.unboundedPreceding, 0)) for p in parts]).alias("s"))
    start = means.select("e", F.lit(0).cast("long").alias("i"), F.array(*[F.lit(0.0)] * len(parts)).alias("s"))
    prefix = prefix.unionByName(start)
    fits = means.filter((F.col("n") >= least) & F.col("varies"))
    size = F.least(F.lit(block).cast("long"), F.col("n"))
    blocks = F.ceil(F.col("n") / size)
    r = fits.select("e", "n", size.alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))).alias("r"), blocks.alias("k"))
    r = r.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    first = F.floor(uniform(seed, 0, F.col("e"), F.col("r") * 4096 + F.col("j")) * (F.col("n") - F.col("size") + 1))
    length = F.when(F.col("j") == F.col("k") - 1, F.col("n") - F.col("size") * (F.col("k") - 1)).otherwise(F.col("size"))
    r = r.withColumn("i", first).withColumn("z", F.col("i") + length)
    sums = r.join(prefix.withColumnRenamed("s", "low"), ["e", "i"]).join(prefix.select("e", F.col("i").alias("z"), F.col("s").alias("high")), ["e", "z"])
    each = sums.groupBy("e", "r").agg(F.array(*[F.sum(F.element_at("high", i) - F.element_at("low", i)) for i in range(1, 10)]).alias("s"))
    slopes = each.select("e", _two_slopes(F.col("s")).alias("b")).filter("b is not null").groupBy("e").agg(F.collect_list("b").alias("bs"))  # ``draws`` numbers
    whole = prefix.join(fits.select("e", F.col("n").alias("i")), ["e", "i"]).select("e", _two_slopes(F.col("s")).alias("beta"))
    out = means.join(whole, "e", "left").join(slopes, "e", "left")
    own = F.col("beta").isNotNull()
    return out.select(
        F.col("e").alias(entity), "n", F.coalesce("beta", F.lit(1.0)).alias("beta"), F.when(own, array_quantile(F.col("bs"), 0.025)).otherwise(0.5).alias("lo"),
        F.when(own, array_quantile(F.col("bs"), 0.975)).otherwise(1.5).alias("hi"), F.when(own, F.size("bs")).otherwise(0).cast("long").alias("used"), (~own).alias("fallback"),
    )
