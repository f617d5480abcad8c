"""Approximate nearest neighbours by cross-polytope hashing.

A table turns a unit vector by three rounds of random signs and a fast Hadamard
transform and assigns it to the nearest signed axis. Several such functions in
a row, the last one over some of the axes only, make a bucket number of any
number of bits. Queries probe the ``probes`` buckets they are closest to in
every table. A bucket's rows and the queries that probe it meet in one task,
which computes exact Euclidean distances in double precision and passes on the
nearest few of each query, so candidate pairs never become rows.

How fine buckets are and how many are probed is measured, on every index alike:
``sample`` queries (a bounded sample) are compared with every row, and of all
bucket sizes the finest is taken for which up to ``most_probes`` probes find
``recall`` of their true neighbours, with the fewest probes that do. The share
of rows that a query visits then falls as the index grows.

* exact copies of a vector are one index row with their smallest ids (as many
  as a query can need), found by a grouped limit before the shuffle;
* a bucket of more than ``shard`` rows is dealt over several tasks, and its
  queries go to each of them;
* a query that met fewer than ``k`` candidates is compared with every row, in
  blocks of queries of bounded size.

Defined results: vectors that are null, zero or hold null or non-finite
components take no part, nor do vectors of another length than the query's;
rows with a repeated id are one candidate each distinct id (its nearest
vector); equal distances go by id; an empty table gives an empty result; other
columns of the input are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_path, stored


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows (a power of two long)."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotate(unit: np.ndarray, seed: int, table: int, function: int) -> np.ndarray:
    dim = 1 << max(0, unit.shape[1] - 1).bit_length()
    x = np.zeros((len(unit), dim))
    x[:, : unit.shape[1]] = unit
    rng = np.random.default_rng([seed, table, function])
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], dim))
    return x


def functions(bits: int, dim: int) -> list[int]:
    """Bits of each function: whole ones (a sign and an axis), then what is left."""
    whole = 1 + max(0, dim - 1).bit_length()
    return [whole] * (bits // whole) + [bits % whole] * (bits % whole > 0)


def probe_codes(vectors: np.ndarray, *, table: int, bits: int, probes: int, seed: int) -> np.ndarray:
    """n x probes bucket codes, nearest first (fewer, if there are no more); the first is the vector's own bucket."""
    unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # so that squares stay finite
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    near, code = np.zeros((len(unit), 1)), np.zeros((len(unit), 1), np.int64)
    for f, b in enumerate(functions(bits, vectors.shape[1])):
        r = rotate(unit, seed, table, f)[:, : 1 << (b - 1)]
        signed = np.concatenate([r, -r], axis=1)
        axes = signed.argmax(axis=1)[:, None] if probes == 1 else np.argsort(-signed, axis=1, kind="stable")[:, :probes]
        # The best sums are sums of the best.
        near = (near[:, :, None] + np.take_along_axis(signed, axes, axis=1)[:, None, :]).reshape(len(r), -1)
        code = (code[:, :, None] << b | axes[:, None, :]).reshape(len(r), -1)
        best = np.argsort(-near, axis=1, kind="stable")[:, :probes]
        near, code = np.take_along_axis(near, best, axis=1), np.take_along_axis(code, best, axis=1)
    return code


def probe_buckets(vectors: np.ndarray, *, table: int, bits: int, probes: int, seed: int) -> np.ndarray:
    return (probe_codes(vectors, table=table, bits=bits, probes=probes, seed=seed) << 10) + table


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and their vectors, for each vector length."""
    lens = column.value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(lens):
        at = np.flatnonzero(lens == n)
        yield at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), int(n))


def _bucketed(tables: int, bits: int, probes: int, seed: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds ``buckets`` to rows whose last column is the vector."""
        for b in batches:
            for at, x in _by_length(b.column(b.num_columns - 1)):
                got = [probe_buckets(x, table=t, bits=bits, probes=probes, seed=seed) for t in range(tables)]
                flat = (np.concatenate(got, axis=1) << 12) + x.shape[1] % 4096
                rows = b.take(pa.array(at))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))
                yield pa.RecordBatch.from_arrays([*rows.columns, lists], names=[*names, "buckets"])

    return run


def nearest(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: pa.ListArray, k: int, room: int = 1 << 21) -> Iterator[tuple[np.ndarray, ...]]:
    """query id, id, distance and row of the vector: each query's k nearest, ties to smaller ids, itself left out.

    Products pick the vectors that may be among the nearest; distances are
    computed from the differences.
    """
    offsets, values = ids.offsets.to_numpy().astype(np.int64), ids.values.to_numpy()
    scale = max(np.abs(queries).max(initial=0), np.abs(vectors).max(initial=0)) or 1.0
    small = vectors / scale  # so that squares stay finite
    x2, most = (small**2).sum(axis=1), min(k + 1, len(vectors))
    step = max(1, room // max(len(vectors), 1))
    for at in range(0, len(queries), step):
        q, mine = queries[at : at + step], own[at : at + step]
        p = q / scale
        d2 = (p**2).sum(axis=1)[:, None] + x2[None] - 2 * p @ small.T
        # Every id but the query's own counts, so k + 1 vectors suffice, with all that may tie with the last.
        limit = np.partition(d2, most - 1, axis=1)[:, most - 1] + 1e-9 * ((p**2).sum(axis=1) + x2.max())
        i, j = np.nonzero(d2 <= limit[:, None])
        d = np.sqrt(((vectors[j] - q[i]) ** 2).sum(axis=1))
        n = offsets[j + 1] - offsets[j]
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        v = values[np.repeat(offsets[j], n) + inner]
        i, j, d = np.repeat(i, n), np.repeat(j, n), np.repeat(d, n)
        other = v != mine[i]
        i, j, d, v = i[other], j[other], d[other], v[other]
        order = np.lexsort((v, d, i))
        i, j, d, v = i[order], j[order], d[order], v[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        keep = rank < k
        yield mine[i[keep]], v[keep], d[keep], j[keep]


ANSWER = "query_id long, vec_id long, score double"


def _packed(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    cols = [np.concatenate([f[c] for f in found]) if found else [] for c in range(3)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])


def _meet(k: int, chunk: int):
    def answers(rows: list[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        t = pa.Table.from_batches(rows).combine_chunks()
        group = t["group"].to_numpy()
        is_query = t["is_query"].to_numpy(zero_copy_only=False).astype(bool)
        for part in np.split(np.arange(len(group)), np.flatnonzero(np.diff(group)) + 1):
            q, x = part[is_query[part]], part[~is_query[part]]
            if not len(q) or not len(x):
                continue
            of = lambda name, at: t[name].take(pa.array(at)).combine_chunks()
            vectors, wanted = (np.concatenate([v for _, v in _by_length(of("embedding", at))]) for at in (x, q))
            yield from nearest(wanted, of("ids", q).flatten().to_numpy(), vectors, of("ids", x), k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows are sorted by group; whole groups are taken, about ``chunk`` rows at a time."""
        held: list[pa.RecordBatch] = []
        for b in batches:
            while b.num_rows:
                held.append(b)
                if sum(x.num_rows for x in held) < chunk:
                    break
                g = np.concatenate([x.column(0).to_numpy() for x in held])
                last = np.flatnonzero(g != g[-1])
                if not len(last):
                    break
                cut = int(last[-1]) + 1
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                yield _packed(list(answers([whole.slice(0, cut)])))
                held, b = [whole.slice(cut)], b.slice(b.num_rows)
        if held:
            yield _packed(list(answers(held)))

    return run


def usable(c: Column) -> Column:
    """Vectors that take part."""
    finite = F.forall(c, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    return F.coalesce(finite & F.exists(c, lambda x: x != 0), F.lit(False))


def _answers(rows: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = rows.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def calibrated(index: DataFrame, asked: DataFrame, n: int, k: int, tables: int, sample: int, recall: float, most_probes: int, seed: int) -> dict:
    """bits and probes, measured on sampled queries; ``found`` is the share of their true neighbours that these probes reach."""
    rows = asked.orderBy(F.xxhash64("ids"), F.col("ids")[0]).limit(sample).collect()
    plan = {"bits": 1, "probes": 2, "found": 1.0}
    if not rows:
        return plan
    ask = index.sparkSession.sparkContext.broadcast([(r["ids"][0], np.array(r["embedding"], np.float64)) for r in rows])
    near = _answers(index.mapInArrow(_scan(ask, k), ANSWER), k)
    where = index.select(F.explode("ids").alias("vec_id"), "embedding").join(F.broadcast(near.select("query_id", "vec_id")), "vec_id")
    vectors = {(r["query_id"], r["vec_id"]): np.array(r["embedding"], np.float64) for r in where.collect()}  # sample * k of them
    ask_of = dict(ask.value)
    pairs = [(ask_of[q], v) for (q, _), v in vectors.items() if len(ask_of[q]) == len(v)]
    if not pairs:
        return plan
    for bits in range(1, min(40, max(2, n).bit_length() + 2)):
        need = np.full(len(pairs), most_probes)
        for dim in {len(q) for q, _ in pairs}:
            at = np.array([i for i, (q, _) in enumerate(pairs) if len(q) == dim])
            q, v = (np.stack([pairs[i][side] for i in at]) for side in (0, 1))
            q, of = np.unique(q, axis=0, return_inverse=True)  # a query has k pairs, and its codes are many
            for t in range(tables):
                codes = probe_codes(q, table=t, bits=bits, probes=most_probes, seed=seed)[of.ravel()]
                own = probe_codes(v, table=t, bits=bits, probes=1, seed=seed)
                same = codes == own
                need[at] = np.minimum(need[at], np.where(same.any(axis=1), same.argmax(axis=1), most_probes))
        probes = int(np.sort(need)[int(np.ceil(recall * len(need))) - 1]) + 1
        if probes <= most_probes:
            plan = {"bits": bits, "probes": probes, "found": float((need < probes).mean())}
    return plan


def nearest_neighbours(
    vectors: DataFrame,
    *,
    is_query: str = "vec_id % 100 = 0",
    k: int = 10,
    tables: int = 8,
    recall: float = 0.95,
    sample: int = 128,
    most_probes: int = 64,
    plan: dict | None = None,
    shard: int = 4096,
    block: int = 2048,
    seed: int = 3,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each query row. ``plan`` (bits and probes) is measured if not given."""
    spark = vectors.sparkSession
    valid = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    # One index row for each different vector, with as many of its smallest ids as any query can use.
    few = Window.partitionBy("embedding").orderBy("vec_id")
    index = valid.withColumn("n", F.dense_rank().over(few)).filter(F.col("n") <= k + 1)
    index = index.groupBy("embedding").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")).select("ids", "embedding")
    index = stored(index, "vectors")
    asked = stored(valid.filter(is_query).select(F.array("vec_id").alias("ids"), "embedding").distinct(), "asked")
    plan = plan or calibrated(index, asked, index.count(), k, tables, sample, recall, most_probes, seed)
    element = vectors.schema["embedding"].dataType.simpleString()
    out = f"ids array<long>, embedding {element}, buckets array<long>"
    coded = stored(index.mapInArrow(_bucketed(tables, plan["bits"], 1, seed, ["ids", "embedding"]), out), "buckets")
    sizes = coded.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("shards"))
    # At most tables / shard of the rows; as a file it is as large as the planner takes it for.
    large = stored(sizes.filter("shards > 1").withColumnRenamed("bucket", "large"), "large")
    placed = coded.select("ids", "embedding", F.explode("buckets").alias("bucket"))
    dealt = placed.join(large, placed["bucket"] == large["large"], "left").withColumn("s", F.pmod(F.xxhash64("ids"), F.coalesce("shards", F.lit(1))))
    dealt = dealt.select(F.xxhash64("bucket", F.col("s").cast("int")).alias("group"), F.lit(False).alias("is_query"), "ids", "embedding")
    # A query's probes look as small as the query to the planner, so both joins merge; its vector comes last.
    probing = asked.repartition(spark.sparkContext.defaultParallelism).mapInArrow(_bucketed(tables, plan["bits"], plan["probes"], seed, ["ids", "embedding"]), out)
    probing = probing.select(F.xxhash64("ids", "embedding").alias("asked"), F.explode("buckets").alias("bucket")).join(sizes.hint("merge"), "bucket")
    probing = probing.select("asked", "bucket", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("s"))
    sent = probing.join(asked.withColumn("asked", F.xxhash64("ids", "embedding")).hint("merge"), "asked")
    sent = sent.select(F.xxhash64("bucket", "s").alias("group"), F.lit(True).alias("is_query"), "ids", "embedding")
    rows = dealt.union(sent).repartition("group").sortWithinPartitions("group", "is_query")
    found = stored(_answers(rows.mapInArrow(_meet(k, 16384), ANSWER), k), "found")

    # Whoever met too few is compared with everything, a bounded block of queries at a time.
    counts = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    short = asked.withColumn("query_id", F.col("ids")[0]).join(counts, "query_id", "left").filter(F.coalesce("n", F.lit(0)) < k).select("query_id", "embedding")
    blocks = stored(short.withColumn("block", F.floor(F.row_number().over(Window.partitionBy(F.pmod("query_id", F.lit(64))).orderBy("query_id")) / (block // 64))), "short")
    where = scratch_path(spark, "scanned")
    found.select("query_id", "vec_id", "score").limit(0).write.parquet(where)
    for row in blocks.select("block").distinct().toLocalIterator():
        ask = spark.sparkContext.broadcast([(r["query_id"], np.array(r["embedding"], np.float64)) for r in blocks.filter(F.col("block") == row["block"]).collect()])
        _answers(index.mapInArrow(_scan(ask, k), ANSWER), k).select("query_id", "vec_id", "score").write.mode("append").parquet(where)
    scanned = spark.read.schema(ANSWER).parquet(where)
    return _answers(found.select("query_id", "vec_id", "score").union(scanned), k)


def _scan(asked, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k nearest of all rows of a task, for each query."""
        best: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            for at, x in _by_length(b.column(1)):
                mine = [(i, v) for i, v in asked.value if len(v) == x.shape[1]]
                if mine:
                    best += nearest(np.array([v for _, v in mine]), np.array([i for i, _ in mine]), x, b.column(0).take(pa.array(at)), k)
            if sum(len(f[0]) for f in best) > 1 << 18:
                best = [_fewest(best, k)]
        yield _packed([_fewest(best, k)] if best else [])

    return run


def _fewest(found: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """The k nearest different ids of each query."""
    q, v, d = (np.concatenate([f[c] for f in found]) for c in range(3))
    order = np.lexsort((d, v, q))
    q, v, d = q[order], v[order], d[order]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (v[1:] != v[:-1])
    q, v, d = q[new], v[new], d[new]
    order = np.lexsort((v, d, q))
    q, v, d = q[order], v[order], d[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], v[keep], d[keep]
