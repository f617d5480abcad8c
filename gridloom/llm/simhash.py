"""SimHash near-duplicates with BK-trees.

Fingerprints within ``radius`` bits of each other are linked; components of
links are groups. The search is cut into shard trees:

* only distinct fingerprints take part (exact copies are one node);
* two fingerprints that differ in at most r bits agree on one of r + 1 bands,
  so each band value is a cell, and a link shows up in some cell. A cell of
  more than ``shard`` fingerprints is cut again by r + 1 bands of its other
  bits, three times at most;
* a cell that fits is one BK-tree (children keyed by the integer Hamming
  distance to the parent), built and searched by the task that holds the cell,
  following only edges within the radius;
* a cell that is still larger is dealt over several shard trees, each with the
  same few leaders of the cell in it. That joins most of a dense cell. What it
  left outside the cell's largest component becomes shard trees that are
  broadcast, at most ``batch`` nodes at a time, and every fingerprint of the
  cell visits them where it lies. Two fingerprints of one cell in different
  components are not both in the largest, so no link is lost, and no group is
  compared pair by pair.

A task never holds more than a shard (and its leaders) of one cell. What it
emits is a spanning forest of the links, never all pairs.

Components: alternating large-star/small-star rounds, each written to the
shared folder; hot nodes are only ever grouped by min() (map-side combined) or
joined by sort-merge, which AQE splits.

Defined results: a null or empty text has fingerprint 0; a null doc_id has a
fingerprint, a null component and no links; repeated rows are kept and belong
to the same component; a doc_id with several texts has a row and a fingerprint
for each, and those whose smallest doc_id it is share a component; an empty
table gives an empty result; other columns of the input are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_path, stored

BITS = 64
STEP = 1024  # more than any distance
FEW_CELLS = 1 << 20  # names of cells that may be broadcast


def shingle_hashes(text: str | None, n: int = 4, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of n words (A-Z lower-cased, joined by single spaces); fewer words: the whole sequence."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    flat = b" ".join(words)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(flat, seed)], np.uint64)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens)[: len(words) - n + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(flat[a:b], seed) for a, b in zip(starts, ends[n - 1 :].tolist(), strict=True)], np.uint64)


def _majority(h: np.ndarray) -> np.ndarray:
    """n x words hashes -> words of 64 bits; a bit is 1 if it is set in over half of the n."""
    n, width = h.shape
    ones = np.zeros(64 * width, np.int64)
    for at in range(0, n, 64 * 255):  # bounded memory for any length
        part = h[at : at + 64 * 255]
        rows = -(-len(part) // 255)
        padded = np.zeros((rows * 255, width), np.uint64)
        padded[: len(part)] = part
        bits = np.unpackbits(padded.view(np.uint8).reshape(rows, 255, 8 * width), axis=2, bitorder="little")
        ones += np.add.reduce(bits, axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)


def _remix(h: np.ndarray, k: int) -> np.ndarray:
    """Another 64 bits from a 64-bit hash (the splitmix finaliser at offset k)."""
    z = h + np.uint64((k * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint(text: str | None, n: int = 4, seed: int = 42, width: int = 1) -> np.ndarray:
    """``width`` 64-bit words; the first is the SimHash of the plain shingle hashes. No words: zero."""
    return of_hashes(shingle_hashes(text, n, seed), width)


def of_hashes(h: np.ndarray, width: int = 1) -> np.ndarray:
    if not len(h):
        return np.zeros(width, np.uint64)
    return _majority(np.stack([h, *[_remix(h, k) for k in range(1, width)]], axis=1))


def fingerprints(docs: DataFrame, *, words: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp: 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(x, words, seed) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).reshape(-1).view(np.int64))], names=["doc_id", "fp"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


class Forest:
    """BK-trees of many groups at once, as flat arrays; built and searched level by level."""

    def __init__(self, fp: np.ndarray, group: np.ndarray):
        self.fp = fp
        order = np.argsort(group, kind="stable")
        groups, first = np.unique(group[order], return_index=True)
        self.roots = dict(zip(groups.tolist(), order[first].tolist(), strict=True))
        self.largest = int(np.diff(np.concatenate([first, [len(order)]])).max()) if len(order) else 0
        parents, edges, nodes = [], [], []
        rest = np.setdiff1d(order, order[first], assume_unique=True)
        parent = np.fromiter((self.roots[g] for g in group[rest].tolist()), np.int64, len(rest))
        while len(rest):
            d = distance(fp[rest], fp[parent])
            key = parent * STEP + d
            _, at, back = np.unique(key, return_index=True, return_inverse=True)
            parents.append(parent[at])
            edges.append(d[at])
            nodes.append(rest[at])
            stay = np.ones(len(rest), bool)
            stay[at] = False
            parent, rest = rest[at][back][stay], rest[stay]
        join = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        key, child = join(parents) * STEP + join(edges), join(nodes)
        order = np.argsort(key)
        self.key, self.child = key[order], child[order]

    def search(self, fp: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) pairs within the radius, a bounded number of queries at a time."""
        step = max(16, (1 << 19) // max(self.largest, 256))
        for at in range(0, len(fp), step):
            q = np.arange(at, min(at + step, len(fp)))
            node = np.fromiter((self.roots.get(g, -1) for g in group[q].tolist()), np.int64, len(q))
            q, node = q[node >= 0], node[node >= 0]
            while len(q):
                d = distance(fp[q], self.fp[node])
                if (hit := d <= radius).any():
                    yield q[hit], node[hit]
                base = node * STEP
                lo = np.searchsorted(self.key, base + np.maximum(d - radius, 0), "left")
                n = np.searchsorted(self.key, base + np.minimum(d + radius, STEP - 1), "right") - lo
                total = int(n.sum())
                into = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)
                q, node = np.repeat(q, n), self.child[into]


def _spanning(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest index reachable from each of n indexes."""
    label = np.arange(n)
    for a, b in pairs:
        while True:
            la, lb = label[a], label[b]
            open_ = la != lb
            if not open_.any():
                break
            low, high = np.minimum(la, lb)[open_], np.maximum(la, lb)[open_]
            np.minimum.at(label, high, low)
            while (label[label] != label).any():
                label = label[label]
            a, b = a[open_], b[open_]
    return label


def _words_of(fp: pa.Array) -> np.ndarray:
    """A column of longs or of equally long binaries as n x words."""
    if pa.types.is_integer(fp.type):
        return fp.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)[:, None]
    return np.frombuffer(b"".join(fp.to_pylist()), np.uint64).reshape(len(fp), -1)


def whole_groups(work):
    """A ``mapInArrow`` function: rows sorted by their first column are passed on in whole groups, as numpy
    columns, together while the sum of their squared sizes stays small."""

    def parts(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not len(cols[0]):
            return
        starts = np.concatenate([[0], np.flatnonzero(np.diff(cols[0])) + 1, [len(cols[0])]])
        squares = np.cumsum(np.diff(starts).astype(np.float64) ** 2) // 8e6
        for part in np.split(np.arange(len(squares)), np.flatnonzero(np.diff(squares)) + 1):
            a, b = starts[part[0]], starts[part[-1] + 1]
            yield from work(*(c[a:b] for c in cols))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(tuple(_words_of(c) if name == "fp" else c.to_numpy(zero_copy_only=False) for name, c in zip(b.schema.names, b.columns, strict=True)))
            if sum(len(x[0]) for x in held) < 32768:
                continue
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            last = int(np.flatnonzero(cols[0] != cols[0][-1])[-1]) + 1 if cols[0][0] != cols[0][-1] else 0
            yield from parts([c[:last] for c in cols])
            held = [tuple(c[last:] for c in cols)]
        if held:
            yield from parts([np.concatenate(x) for x in zip(*held, strict=True)])

    return run


def _joined(u: np.ndarray, v: np.ndarray, names: tuple[str, str] = ("u", "v")) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=list(names))


def _link_cells(radius: int):
    def links(group: np.ndarray, fp: np.ndarray, node: np.ndarray):
        order = np.argsort(node, kind="stable")  # so that the smallest index is the smallest node
        group, fp, node = group[order], fp[order], node[order]
        label = _spanning(len(fp), Forest(fp, group).search(fp, group, radius))
        moved = np.flatnonzero(node[label] != node)
        yield _joined(node[moved], node[label[moved]])

    return whole_groups(links)


def _bands(bits: list[int], parts: int) -> list[list[int]]:
    return [bits[len(bits) * i // parts : len(bits) * (i + 1) // parts] for i in range(parts)]


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << BITS) if m >> (BITS - 1) else m


def link_fingerprints(nodes: DataFrame, *, radius: int = 4, shard: int = 2048, batch: int = 1 << 17, cuts: int = 3) -> DataFrame:
    """``fp, node`` (both unique) -> edges u > v: forests that span the links."""
    fixed: list[list[int]] = [[]]  # bits that the cells of each path agree on
    rows, found = nodes.select("fp", "node", F.lit(0).alias("path")), None
    for cut in range(cuts):
        bands = [[f + b for b in _bands([x for x in range(BITS) if x not in f], radius + 1)] for f in fixed]
        masks = F.element_at(F.array(*[F.array(*[F.lit(_mask(b)) for b in row]) for row in bands]), F.col("path") + 1)
        path = lambda i: F.col("path") * (radius + 1) + i  # noqa: E731, B023
        cells = F.transform(masks, lambda m, i: F.struct(path(i).alias("path"), F.xxhash64(path(i), F.col("fp").bitwiseAND(m)).alias("cell")))
        fits, large = by_size(rows.select("fp", "node", F.explode(cells).alias("c")).select("fp", "node", "c.*"), shard, f"cells{cut}")
        fits = fits.select(F.col("cell").alias("group"), "fp", "node")
        found = fits if found is None else found.union(fits)
        fixed, rows = [b for row in bands for b in row], large.select("fp", "node", "path")
        if large.isEmpty():
            return found.repartition("group").sortWithinPartitions("group").mapInArrow(_link_cells(radius), "u long, v long").distinct()
    large = large.select("cell", "fp", "node", "size")
    links = found.union(dealt(large, shard)).repartition("group").sortWithinPartitions("group").mapInArrow(_link_cells(radius), "u long, v long").distinct()
    links = stored(links, "links")
    rows, rest = outside(large.drop("size"), components(links))

    def spanning(q: dict[str, np.ndarray], t: dict[str, np.ndarray], pairs) -> pa.RecordBatch:
        ids, at = np.unique(np.concatenate([q["node"], t["node"]]), return_inverse=True)
        n = len(q["node"])
        label = _spanning(len(ids), ((at[:n][a], at[n:][b]) for a, b in pairs))
        moved = np.flatnonzero(label != np.arange(len(ids)))
        return _joined(ids[moved], ids[label[moved]])

    more = broadcast_search(rows, rest, radius, batch, spanning, "u long, v long")
    return links.union(more).distinct()


def by_size(df: DataFrame, shard: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows of cells that fit one tree, and rows of larger ones with the cell's size."""
    df = stored(df, name)
    large = stored(df.groupBy("cell").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > shard), "large")
    if large.isEmpty():
        return df, df.withColumn("size", F.lit(0).cast("long")).limit(0)
    side = F.broadcast(large) if large.count() <= FEW_CELLS else large
    return df.join(side, "cell", "left_anti"), df.join(side, "cell")


def dealt(large: DataFrame, shard: int, leaders: int = 8) -> DataFrame:
    """Rows of large cells (with ``size``) as groups of about ``shard``, each with the same few leaders of its cell."""
    rest = [c for c in large.columns if c not in ("cell", "size")]
    shards = F.ceil(F.col("size") / shard).cast("int")
    own = F.pmod(F.xxhash64("node"), shards).cast("int")
    first = Window.partitionBy("cell").orderBy(F.xxhash64("node"), "node")
    lead = large.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= leaders)
    lead = lead.withColumn("_s", F.explode(F.sequence(F.lit(0), shards - 1))).filter(F.col("_s") != own)
    return large.select(F.xxhash64("cell", own).alias("group"), *rest).union(lead.select(F.xxhash64("cell", "_s").alias("group"), *rest))


def outside(rows: DataFrame, comp: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of cells with their ``component``, and those that are not in their cell's largest one."""
    rows = rows.join(comp.withColumnRenamed("u", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = stored(rows, "open_cells")
    sizes = rows.groupBy("cell", "component").agg(F.count(F.lit(1)).alias("_n"))
    main = sizes.groupBy("cell").agg(F.max_by("component", F.struct("_n", -F.col("component"))).alias("_main"))
    return rows, stored(rows.join(main, "cell").filter("component <> _main").drop("_main"), "outside")


def broadcast_search(rows: DataFrame, trees: DataFrame, radius: int, batch: int, emit, schema: str) -> DataFrame:
    """Shard trees of ``trees`` (cell, fp, node, component, ...), about ``batch`` nodes at a time, are broadcast to all ``rows``.

    ``emit`` makes an Arrow batch of (columns of queries, columns of tree nodes, pairs of positions with different components).
    """
    spark, names = rows.sparkSession, rows.columns
    where = scratch_path(spark, "visits")
    spark.createDataFrame([], schema).write.parquet(where)
    parts = -(-trees.count() // batch)

    def columns(b: pa.RecordBatch | pa.Table) -> dict[str, np.ndarray]:
        return {n: _words_of(b.column(n)) if n == "fp" else b.column(n).to_numpy(zero_copy_only=False) for n in names}

    for k in range(parts):
        some = trees.select(*names).filter(F.pmod(F.xxhash64("cell", "node"), F.lit(parts)) == k)
        held = spark.sparkContext.broadcast(columns(some.toArrow().combine_chunks().to_batches()[0]) if not some.isEmpty() else None)
        if held.value is None:
            continue

        def visit(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            t = held.value
            forest = Forest(t["fp"], t["cell"])
            for b in batches:
                q = columns(b)
                far = ((x[keep], y[keep]) for x, y in forest.search(q["fp"], q["cell"], radius) for keep in [q["component"][x] != t["component"][y]])
                yield emit(q, t, far)

        rows.mapInArrow(visit, schema).write.mode("append").parquet(where)
        held.destroy()
    return spark.read.schema(schema).parquet(where)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Edges u > v -> u, component (the smallest node reachable); nodes that are their own component are left out."""
    edges, before = stored(edges.select("u", "v"), "edges"), None
    for _ in range(rounds):
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(low, "u")
        small = near.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    return edges.select("u", F.col("v").alias("component"))


def near_duplicates(docs: DataFrame, *, words: int = 4, radius: int = 4, seed: int = 42, shard: int = 2048, batch: int = 1 << 17) -> DataFrame:
    """doc_id, fp, component_id; every link is found."""
    fps = stored(fingerprints(docs, words=words, seed=seed), "fingerprints")
    nodes = stored(fps.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    comp = components(link_fingerprints(nodes, radius=radius, shard=shard, batch=batch))
    classes = nodes.join(comp, nodes["node"] == comp["u"], "left").select("fp", F.coalesce("component", "node").alias("component"))
    joined = fps.join(classes, "fp", "left")
    return joined.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))
