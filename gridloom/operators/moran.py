"""Moran's I with permutation inference.

A permutation of n sites is a keyed bijection of 0..n-1, computed where it is
needed: some rounds, each of which swaps a number with its mirror image around a
round key or leaves the pair alone, by one hash bit that both share. It holds
for any n, so values are permuted by one equi-join on the number and never by a
sort, and a lost task computes the same permutation again. All permutations of a
site travel as one array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stored

ROUNDS = 24


def mixed(a: Column, b: Column) -> Column:
    """A portable hash of two small whole numbers to 0..2^31-2."""
    left = (a * 73856093 + b * 19349663) % 2147483647
    right = (a * 83492791 + b * 2654435) % 1000003 + 1
    return (left * right) % 2147483647


def permuted(i: Column, key: Column, n: Column) -> Column:
    """Where permutation ``key`` sends ``i`` of 0..n-1."""
    whole = lambda c: c.cast("long")

    def swap(x: Column, turn: Column) -> Column:
        k = whole(key) * 64 + turn
        mirror = F.pmod(mixed(k, F.lit(7919).cast("long")) % n - x, n)
        return F.when(F.floor(mixed(F.greatest(x, mirror) + 1, k) / 1024) % 2 == 1, mirror).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.lit(ROUNDS - 1).cast("long")), whole(i), swap)


def _all_permuted(permutations: int):
    """Rows of (site, n) -> (site, k, from) for each permutation; as ``permuted``, on whole arrays."""

    def mix(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
        return (a * 73856093 + b * 19349663) % 2147483647 * ((a * 83492791 + b * 2654435) % 1000003 + 1) % 2147483647

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = np.arange(1, permutations + 1, dtype=np.int64)[None]
        step = max(1, (1 << 18) // permutations)
        for b in batches:
            for at in range(0, b.num_rows, step):
                site, n = (b.column(i).slice(at, step).to_numpy() for i in (0, 1))
                x, n = np.broadcast_to(site[:, None], (len(site), permutations)), n[:, None]
                for turn in range(ROUNDS):
                    key = k * 64 + turn
                    mirror = (mix(key, 7919) % n - x) % n
                    x = np.where(mix(np.maximum(x, mirror) + 1, key) // 1024 % 2 == 1, mirror, x)
                cols = [np.repeat(site, permutations), np.tile(k[0], len(site)), x.ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["site", "k", "from"])

    return run


def moran_test(values: DataFrame, edges: DataFrame, site: str, value: str, permutations: int) -> DataFrame:
    """n, moran_i, expected_i, z, p, larger: one row.

    ``values``: ``site`` is 0..n-1, each once; rows with a null value are not
    allowed to be numbered. ``edges``: ``site``, ``site``_b, weighted by 1 / the
    site's number of neighbours. ``p`` is one-sided: (r + 1) / (permutations + 1)
    with r the number of permutations at least as large, or the rest if fewer.
    Null where values do not vary or no site has a neighbour.
    """
    v = stored(values.select(F.col(site).cast("long").alias("site"), F.col(value).cast("double").alias("x")), "sites")
    whole = v.agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), (F.count("x") * F.var_pop("x")).alias("ss"))
    z = v.crossJoin(F.broadcast(whole)).select("site", "n", (F.col("x") - F.col("m")).alias("z"))  # one row of totals
    sent = z.select("site", "n").mapInArrow(_all_permuted(permutations), "site long, k long, `from` long")
    got = sent.join(z.select(F.col("site").alias("from"), F.col("z").alias("v")).hint("merge"), "from").groupBy("site").agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("p"))
    field = z.join(got.hint("merge"), "site").select("site", F.concat(F.array("z"), F.transform("p", lambda x: x["v"])).alias("f"))
    field = stored(field, "fields")  # the values themselves, then every permutation of them
    pairs = edges.select(F.col(site).cast("long").alias("site"), F.col(f"{site}_b").cast("long").alias("near"))
    degree = pairs.groupBy("site").agg(F.count(F.lit(1)).alias("d"))
    met = pairs.join(degree.hint("merge"), "site").join(field.hint("merge"), "site").join(field.select(F.col("site").alias("near"), F.col("f").alias("g")).hint("merge"), "near")
    part = met.select(F.posexplode(F.zip_with("f", "g", lambda a, b: a * b)).alias("k", "c"), "d").groupBy("k").agg(F.sum(F.col("c") / F.col("d")).alias("cross"))
    s0 = degree.agg(F.count(F.lit(1)).cast("double").alias("s0"))
    i = part.crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(s0)).select("k", "n", F.try_divide(F.col("n") / F.col("s0") * F.col("cross"), F.col("ss")).alias("i"))
    own = F.max(F.when(F.col("k") == 0, F.col("i")))
    sims = i.crossJoin(F.broadcast(i.agg(own.alias("own"))))
    of = F.when(F.col("k") > 0, F.col("i"))
    r = sims.groupBy("own", "n").agg(F.avg(of).alias("mean"), F.stddev_pop(of).alias("sd"), F.count_if((F.col("k") > 0) & (F.col("i") >= F.col("own"))).alias("r"))
    larger = F.least(F.col("r"), permutations - F.col("r"))
    return r.select(
        "n", F.col("own").alias("moran_i"), (-1 / (F.col("n") - 1)).alias("expected_i"), F.try_divide(F.col("own") - F.col("mean"), F.col("sd")).alias("z"),
        F.when(F.col("own").isNotNull(), (larger + 1) / (permutations + 1)).alias("p"), larger.alias("larger"),
    )
