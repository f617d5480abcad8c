"""Near copies: SimHash trees find candidates, the whole shingle sets decide.

Two documents are linked if the Jaccard similarity of their sets of word
shingles reaches ``similarity``; components of links are groups. Candidates are
pairs whose SimHash fingerprints of 64 * ``width`` bits are within a radius,
found by BK-trees in cells: a cell is a table and some sampled bits of the
fingerprint. At similarity s (sets of equal size; others are closer) each bit
differs with chance arccos(2s / (1 + s)) / pi. From that follow

* the radius that holds such a pair with a chance above ``recall``,
* the sampled bits, which grow with the logarithm of the number of different
  texts, so that a cell holds ``cell`` of them on average,
* and the number of tables, so that a pair at the limit itself is met and
  within the radius with a chance of ``recall`` or more. Closer pairs are met
  with a higher one.

Every candidate is checked on the whole sets before it links anything, so no
link is false.

Dense cells are not paired out. A cell with more than four hits a document
emits a spanning forest of its hits, nearest first, and a cell too large for
one tree is dealt over shards with common leaders. Once these have been checked
and joined, what such a cell has outside its largest component becomes shard
trees that are broadcast in bounded batches, visited by all of the cell, and
only hits between different components are checked. Two texts of one component
need no link of their own.

Defined results: texts without words are copies of each other; a null doc_id
has no row; rows that repeat a doc_id with different texts are a row each,
and their groups are those of their own texts; an empty table gives an empty
result; other columns of the input are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .simhash import Forest, broadcast_search, by_size, components, dealt, distance, of_hashes, outside, shingle_hashes, whole_groups

DENSE = 4  # hits a document that a cell may emit without thinning


def shingle_set(text: str | None, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))


def search_plan(texts: int, *, similarity: float = 0.8, width: int = 4, recall: float = 0.99, cell: int = 96) -> tuple[int, int, int]:
    """Radius, sampled bits and tables for a number of different texts."""
    n = 64 * width
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    d = np.arange(n + 1)
    log = np.array([math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p) for k in d.tolist()])
    share = np.exp(log)
    radius = int(np.argmax(np.cumsum(share) >= 1 - 0.4 * (1 - recall)))
    bits = max(1, min(48, round(math.log2(max(texts, 2) / cell))))
    meet = (1 - d[: radius + 1] / n) ** bits
    tables = next(t for t in range(1, 100_000) if (share[: radius + 1] * (1 - (1 - meet) ** t)).sum() >= recall)
    return radius, bits, tables


def signatures(docs: DataFrame, words: int, width: int) -> DataFrame:
    """doc_id, digest of the shingle set, n (its size), fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(x, words) for x in b.column(1).to_pylist()]
            digest = pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in sets], pa.binary())
            fp = pa.array([of_hashes(h, width).tobytes() for h in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), digest, pa.array([len(h) for h in sets], pa.int32()), fp], names=["doc_id", "digest", "n", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, digest binary, n int, fp binary")


def _sampled(bits: int, tables: int, width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        chosen = [rng.choice(64 * width, bits, replace=False) for _ in range(tables)]
        for b in batches:
            if not b.num_rows:
                continue
            raw = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            on = np.unpackbits(raw, axis=1, bitorder="little")
            weight = np.int64(1) << np.arange(bits)
            for t, at in enumerate(chosen):
                cell = on[:, at].astype(np.int64) @ weight + (np.int64(t) << np.int64(bits))
                yield pa.RecordBatch.from_arrays([pa.array(cell), *b.columns], names=["cell", *b.schema.names])

    return run


def _close(x: np.ndarray, y: np.ndarray, least: Fraction) -> np.ndarray:
    """Sizes of two sets that can reach the similarity."""
    return np.minimum(x, y).astype(np.int64) * least.denominator >= np.maximum(x, y).astype(np.int64) * least.numerator


def nearest_forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions of edges (sorted by length) that span what all of them join: each tree takes its shortest edge out, until none is left."""
    label, kept, open_ = np.arange(n), [], np.arange(len(a))
    while True:
        la, lb = label[a[open_]], label[b[open_]]
        out = la != lb
        open_, la, lb = open_[out], la[out], lb[out]
        if not len(open_):
            return np.unique(np.concatenate(kept)) if kept else np.empty(0, np.int64)
        _, first = np.unique(np.stack([la, lb], axis=1).ravel(), return_index=True)
        chosen = np.unique(first // 2)
        kept.append(open_[chosen])
        x, y = np.minimum(la, lb)[chosen], np.maximum(la, lb)[chosen]
        while len(x):
            np.minimum.at(label, y, x)
            while (label[label] != label).any():
                label = label[label]
            x, y = label[x], label[y]
            x, y = np.minimum(x, y)[x != y], np.maximum(x, y)[x != y]


def _candidates(radius: int, least: Fraction):
    def pairs(group: np.ndarray, fp: np.ndarray, node: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Pairs a < b to check; a group that kept some back is named in ``open``."""
        found = [(q[keep], k[keep]) for q, k in Forest(fp, group).search(fp, group, radius) for keep in [(node[q] < node[k]) & _close(n[q], n[k], least)]]
        a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2
        start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        which = np.cumsum(np.concatenate([[True], group[1:] != group[:-1]])) - 1
        dense = np.bincount(which[a], minlength=len(start)) > DENSE * np.bincount(which)
        keep = ~dense[which[a]]
        thin = np.flatnonzero(~keep)
        thin = thin[np.argsort(distance(fp[a[thin]], fp[b[thin]]), kind="stable")]
        at = np.concatenate([np.flatnonzero(keep), thin[nearest_forest(len(group), a[thin], b[thin])]]).astype(np.int64)
        left = group[start[dense]]
        nothing = pa.nulls(len(left), pa.int64())
        columns = [pa.concat_arrays([pa.array(node[a[at]], pa.int64()), nothing]), pa.concat_arrays([pa.array(node[b[at]], pa.int64()), nothing]), pa.concat_arrays([pa.nulls(len(at), pa.int64()), pa.array(left, pa.int64())])]
        yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "open"])

    return whole_groups(pairs)


def verified(pairs: DataFrame, docs: DataFrame, words: int, least: Fraction) -> DataFrame:
    """Those of the pairs ``a < b`` whose sets reach the similarity, as edges u > v."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(x, words).tobytes() for x in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "set"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both * least.denominator >= least.numerator * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(0)], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    ids = pairs.select(F.explode(F.array("a", "b")).alias("_id")).distinct()
    held = stored(docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("_id"), "left_semi").mapInArrow(sets, "doc_id long, set binary"), "sets")
    both = pairs.join(held.select(F.col("doc_id").alias("a"), F.col("set").alias("x")), "a").join(held.select(F.col("doc_id").alias("b"), F.col("set").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(check, "u long, v long").distinct()


def near_copies(
    docs: DataFrame, *, words: int = 5, similarity: str = "0.8", width: int = 4, recall: float = 0.99, cell: int = 96, shard: int = 2048, batch: int = 1 << 17, seed: int = 5
) -> DataFrame:
    """doc_id, component_id: the smallest doc_id that a chain of links reaches."""
    least = Fraction(similarity)
    docs = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = stored(signatures(docs, words, width), "signatures")
    nodes = stored(found.groupBy("digest").agg(F.min(F.struct("doc_id", "n", "fp")).alias("r")).select("digest", F.col("r.doc_id").alias("node"), "r.n", "r.fp"), "nodes")
    radius, bits, tables = search_plan(nodes.count(), similarity=float(least), width=width, recall=recall, cell=cell)
    rows = nodes.select("fp", "node", "n").mapInArrow(_sampled(bits, tables, width, seed), "cell long, fp binary, node long, n int")
    fits, large = by_size(rows, shard, "cells")
    first = fits.select(F.col("cell").alias("group"), "fp", "node", "n").union(dealt(large, shard))
    out = stored(first.repartition("group").sortWithinPartitions("group").mapInArrow(_candidates(radius, least), "a long, b long, open long"), "candidates")
    pairs = stored(out.filter("a is not null").select("a", "b").distinct(), "pairs")
    links = stored(verified(pairs, docs, words, least), "links")
    comp = components(links)

    # What dense and large cells kept back: hits between different components.
    left = out.filter("open is not null").select(F.col("open").alias("cell")).distinct()
    rest = fits.join(left, "cell", "left_semi").select("cell", "fp", "node", "n").union(large.select("cell", "fp", "node", "n"))
    if not rest.isEmpty():
        rest, trees = outside(rest, comp)

        def between(q: dict[str, np.ndarray], t: dict[str, np.ndarray], hits) -> pa.RecordBatch:
            got = [(q["node"][x[keep]], t["node"][y[keep]]) for x, y in hits for keep in [_close(q["n"][x], t["n"][y], least)]]
            a, b = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.empty(0, np.int64),) * 2
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        more = broadcast_search(rest, trees, radius, batch, between, "a long, b long").distinct().join(pairs, ["a", "b"], "left_anti")
        more = stored(more, "more_pairs")
        if not more.isEmpty():
            comp = components(links.union(verified(more, docs, words, least)))
    classes = nodes.join(comp, nodes["node"] == comp["u"], "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    return found.join(classes, "digest").select("doc_id", "component_id")
