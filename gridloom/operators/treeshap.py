"""Shapley values and interactions of tree ensembles, path by path.

A leaf with the conditions of d different features is a product game: with the
features in S known, its path is followed with weight prod(o_j, j in S) *
prod(z_j, j not in S), where o_j says whether the row meets the leaf's conditions
on feature j, and z_j is the share of training rows that go that way. Shapley
weights are integrals, k! (d-1-k)! / d! = int t^k (1-t)^(d-1-k) dt, so

    phi_i  = v (o_i - z_i) int prod_{j != i} (z_j (1 - t) + o_j t) dt
    Phi_ij = v (o_i - z_i) (o_j - z_j) int prod_{k != i, j} (...) dt / 2

and as the integrands are polynomials of a degree under d, Gauss-Legendre nodes
give them exactly: d^2 products a leaf (d^3 with interactions), never 2^d
subsets. Groups of features are sums over their members.

Rows go through as Arrow batches; the shares z come from one grouped count of
the leaves that rows reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def leaf_number(tree: dict, columns: list[Column], numbers: Iterator[int]) -> Column:
    """The number of the leaf that a row reaches, left to right, as a CASE expression."""
    if "leaf" in tree:
        return F.lit(next(numbers))
    x = columns[tree["feature"]]
    left, right = leaf_number(tree["left"], columns, numbers), leaf_number(tree["right"], columns, numbers)
    return F.when(x.isNull(), left if tree.get("default_left", True) else right).when(x < float(tree["threshold"]), left).otherwise(right)


def leaf_counts(df: DataFrame, trees: list[dict], columns: list[Column]) -> list[list[int]]:
    """Rows in each leaf of each tree, in one pass; as many numbers as there are leaves."""
    reached, sizes = [], []
    for t in trees:
        numbers = iter(range(1 << 20))
        reached.append(leaf_number(t, columns, numbers))
        sizes.append(next(numbers))
    at = df.select(F.posexplode(F.array(*reached)).alias("tree", "leaf")).groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n"))
    out = [[0] * n for n in sizes]
    for r in at.collect():
        out[r["tree"]][r["leaf"]] = r["n"]
    return out


class Leaf:
    """A leaf's value and, for each feature of its path, the conditions and the share of rows that meet them."""

    def __init__(self, value: float, steps: list[tuple[int, float, bool, bool, float]]):
        self.value = value
        self.features = sorted({s[0] for s in steps})
        self.conditions = [[s[1:4] for s in steps if s[0] == f] for f in self.features]
        self.share = np.array([np.prod([s[4] for s in steps if s[0] == f]) for f in self.features])

    def met(self, x: np.ndarray) -> np.ndarray:
        """features x rows: 1 where the row meets all conditions on the feature."""
        on = np.ones((len(self.features), len(x)))
        for k, (f, of) in enumerate(zip(self.features, self.conditions, strict=True)):
            v = x[:, f]
            for threshold, left, default_left in of:
                on[k] *= np.where(np.isnan(v), default_left, v < threshold) == left
        return on


def leaves(tree: dict, counts: list[int]) -> list[Leaf]:
    """All leaves of a tree; ``counts`` rows in each, left to right. Where a node has no row, its children share equally."""
    numbers = iter(counts)

    def walk(node: dict) -> tuple[int, list[tuple[float, list]]]:
        if "leaf" in node:
            return next(numbers), [(float(node["leaf"]), [])]
        (a, left), (b, right) = walk(node["left"]), walk(node["right"])
        share = a / (a + b) if a + b else 0.5
        step = (node["feature"], float(node["threshold"]))
        default = node.get("default_left", True)
        return a + b, [(v, [(*step, True, default, share), *s]) for v, s in left] + [(v, [(*step, False, default, 1 - share), *s]) for v, s in right]

    return [Leaf(v, s) for v, s in walk(tree)[1]]


class Explainer:
    """Contributions of a fixed ensemble; ``groups[f]`` is the group of feature f."""

    def __init__(self, trees: list[dict], counts: list[list[int]], base: float, groups: list[int]):
        self.leaves = [leaf for t, n in zip(trees, counts, strict=True) for leaf in leaves(t, n)]
        self.groups, self.size = groups, max(groups) + 1
        self.expected = base + sum(leaf.value * float(np.prod(leaf.share)) for leaf in self.leaves)
        deepest = max((len(leaf.features) for leaf in self.leaves), default=1)
        self.nodes = {d: self._nodes(d) for d in range(1, deepest + 1)}

    @staticmethod
    def _nodes(d: int) -> tuple[np.ndarray, np.ndarray]:
        """Exact for polynomials of degree d - 1 on 0..1."""
        t, w = np.polynomial.legendre.leggauss((d + 1) // 2)
        return (t + 1) / 2, w / 2

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """rows x groups; with ``expected`` they add up to the prediction."""
        out = np.zeros((self.size, len(x)))
        for leaf in self.leaves:
            if leaf.features:
                t, w = self.nodes[len(leaf.features)]
                on = leaf.met(x)
                gain, rest = on - leaf.share[:, None], self._terms(leaf, on, t)
                for i, f in enumerate(leaf.features):
                    out[self.groups[f]] += leaf.value * gain[i] * (w @ np.prod(np.delete(rest, i, axis=0), axis=0))
        return out.T

    def interactions(self, x: np.ndarray) -> np.ndarray:
        """rows x groups x groups; a row's sum over one group is that group's contribution, the diagonal holds what acts within a group."""
        out = np.zeros((self.size, self.size, len(x)))
        own = self.contributions(x).T
        for leaf in self.leaves:
            d = len(leaf.features)
            if d < 2:
                continue
            t, w = self.nodes[d]
            on = leaf.met(x)
            gain, rest = on - leaf.share[:, None], self._terms(leaf, on, t)
            for i in range(d):
                for j in range(i + 1, d):
                    a, b = self.groups[leaf.features[i]], self.groups[leaf.features[j]]
                    if a != b:
                        both = leaf.value * gain[i] * gain[j] * (w @ np.prod(np.delete(rest, (i, j), axis=0), axis=0)) / 2
                        out[a, b] += both
                        out[b, a] += both
        for g in range(self.size):
            out[g, g] = own[g] - (out[g].sum(axis=0) - out[g, g])
        return out.transpose(2, 0, 1)

    @staticmethod
    def _terms(leaf: Leaf, on: np.ndarray, t: np.ndarray) -> np.ndarray:
        """features x nodes x rows."""
        return leaf.share[:, None, None] * (1 - t)[None, :, None] + on[:, None, :] * t[None, :, None]


def _features(b: pa.RecordBatch, n: int) -> np.ndarray:
    cols = [b.column(b.num_columns - n + i).to_numpy(zero_copy_only=False).astype(float) for i in range(n)]
    return np.stack(cols, axis=1) if b.num_rows else np.empty((0, n))


def explain(df: DataFrame, explainer: Explainer, keys: list[str], columns: list[Column], tolerance: float = 1e-3, predicted: Column | None = None) -> DataFrame:
    """keys, shap_0..shap_g, expected. With ``predicted`` a row whose contributions do not add up to it fails the job."""
    n, check = len(columns), predicted is not None
    names = [f"shap_{g}" for g in range(explainer.size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                b = batch.slice(at, 4096)
                phi = explainer.contributions(_features(b, n))
                if check:
                    off = np.abs(phi.sum(axis=1) + explainer.expected - b.column(len(keys)).to_numpy(zero_copy_only=False)).max(initial=0)
                    if not off < tolerance:
                        raise ValueError(f"contributions miss the prediction by {off:.3g}")
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], *[pa.array(c) for c in phi.T], pa.array(np.full(len(phi), explainer.expected))], names=[*keys, *names, "expected"])

    extra = [predicted.cast("double").alias("_p")] if check else []
    inputs = df.select(*keys, *extra, *[c.cast("double").alias(f"_x{i}") for i, c in enumerate(columns)])
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return inputs.mapInArrow(run, f"{schema}, " + ", ".join(f"{c} double" for c in (*names, "expected")))


def mean_interactions(df: DataFrame, explainer: Explainer, by: str, columns: list[Column]) -> DataFrame:
    """by, g, h, mean_abs, n: the mean size of every pair of groups, for each value of ``by``; a task sends one row a value and pair."""
    n, size = len(columns), explainer.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                of = np.array(b.column(0).to_pylist(), object)
                g = np.abs(explainer.interactions(_features(b, n)))
                for k in set(of.tolist()):
                    total, rows = sums.get(k, (np.zeros((size, size)), 0))
                    sums[k] = total + g[of == k].sum(axis=0), rows + int((of == k).sum())
        i, j = (m.ravel() for m in np.indices((size, size)))
        keys = [k for k in sums for _ in i]
        cols = [np.tile(i, len(sums)), np.tile(j, len(sums)), np.concatenate([t.ravel() for t, _ in sums.values()] or [np.empty(0)]), np.repeat([r for _, r in sums.values()], size * size)]
        yield pa.RecordBatch.from_arrays([pa.array(keys, batch_type), *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)]], names=[by, "g", "h", "total", "n"])

    from pyspark.sql.pandas.types import to_arrow_type

    batch_type = to_arrow_type(df.schema[by].dataType)
    rows = df.select(by, *[c.cast("double").alias(f"_x{i}") for i, c in enumerate(columns)])
    parts = rows.mapInArrow(run, f"`{by}` {df.schema[by].dataType.simpleString()}, g long, h long, total double, n long")
    return parts.groupBy(by, "g", "h").agg((F.sum("total") / F.sum("n")).alias("mean_abs"), F.sum("n").alias("n"))
