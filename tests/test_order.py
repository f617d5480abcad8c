"""Selection and atom-aware bins against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import order

PROBS = [0.0, 0.01, 0.37, 0.5, 0.9, 1.0]


@pytest.mark.parametrize("small", [3, 1 << 16])
def test_quantiles_of_groups(spark, small):
    r = np.random.default_rng(1)
    groups = {
        "normal": r.normal(size=500),
        "one": np.array([3.5]),
        "equal": np.full(300, -2.0),
        "atoms": np.concatenate([np.zeros(400), r.normal(size=50), np.full(200, 7.0)]),
        "heavy": np.exp(r.normal(0, 20, 700)),
        "wide": np.array([-1.7e308, 1.7e308, 0.0, 1.0, 2.0]),
        None: r.normal(size=90),
    }
    rows = [(k, 1, float(v)) for k, x in groups.items() for v in x] + [("normal", 1, None), ("normal", 1, float("nan")), ("normal", 1, float("inf")), ("void", 1, None)]
    got = {x.k: (x.n, x.q) for x in order.quantiles(spark.createDataFrame(rows, "k string, j int, v double"), ["k", "j"], F.col("v"), PROBS, small=small).collect()}
    assert got.keys() == groups.keys()
    for k, x in groups.items():
        assert got[k][0] == len(x)
        if k != "wide":
            assert got[k][1] == pytest.approx(np.quantile(x, PROBS).tolist(), rel=1e-12)
    assert got["wide"][1][3] == 1.0


def test_quantiles_of_a_whole_table_and_of_none(spark):
    d = spark.range(1001).select(F.col("id").cast("double").alias("v"))
    assert order.quantiles(d, [], F.col("v"), [0.25], small=7).first().q == [250.0]
    assert order.quantiles(d.limit(0), [], F.col("v"), [0.25]).count() == 0


def edges_of(x, bins):
    """The rule, one step at a time, on an array."""
    x = np.asarray(x, float)
    values, counts = np.unique(x, return_counts=True)
    atoms = values[counts * bins >= len(x)]
    rest = x[~np.isin(x, atoms)]
    cuts = np.quantile(rest, np.linspace(0, 1, max(1, bins - len(atoms)) + 1)) if len(rest) else []
    e = sorted({x.min(), x.max(), *atoms, *np.nextafter(atoms, np.inf), *cuts})
    held = lambda a, z, last: int(((x >= a) & ((x <= z) if last else (x < z))).sum())
    count = lambda: [held(a, z, i == len(e) - 2) for i, (a, z) in enumerate(zip(e, e[1:], strict=False))]
    while len(e) > 2 and 0 in count():
        i = count().index(0)
        e.pop(i if i else 1)
    while len(e) - 1 > bins:
        n = count()
        atom = [a in atoms and z == np.nextafter(a, np.inf) for a, z in zip(e, e[1:], strict=False)]
        best = None
        for b in np.argsort(n, kind="stable"):
            near = [k for k in (b - 1, b + 1) if 0 <= k < len(n) and not atom[k]]
            if not atom[b] and near:
                best = max(b, min(near, key=lambda k: n[k]))
                break
        if best is None:
            break
        e.pop(best)
    return e


@pytest.mark.parametrize("bins", [1, 6])
def test_atom_aware_edges(spark, bins):
    r = np.random.default_rng(bins)
    cases = [
        r.normal(size=400),
        np.concatenate([np.zeros(100), r.uniform(1, 2, 300)]),
        np.concatenate([np.zeros(60), np.full(60, 0.5), r.uniform(0, 1, 200), np.ones(80)]),
        np.full(30, 4.0),
    ]
    for x in cases:
        d = spark.createDataFrame([(float(v),) for v in x], "v double")
        got = order.atom_edges(d, F.col("v"), bins, small=32)
        assert got == pytest.approx(edges_of(x, bins), rel=1e-12)
        n = {q.b: q["count"] for q in d.groupBy(order.bin_of(F.col("v"), got).alias("b")).count().collect()}
        assert sum(n.values()) == len(x) and set(n) == set(range(len(got) - 1))


def test_edges_of_nothing(spark):
    d = spark.createDataFrame([(None,), (float("nan"),)], "v double")
    assert order.atom_edges(d, F.col("v"), 4) == [0.0, 0.0]


def test_running_sums_and_ranks(spark):
    """Against plain counting: a hot group, ties, null keys and values, more ranges than values, and names of other columns."""
    r = np.random.default_rng(4)
    rows = [("hot" if i % 3 else None if i % 5 == 0 else "g" + str(i % 4), i, None if i % 41 == 0 else float(r.integers(0, 12)), "x") for i in range(900)]
    d = spark.createDataFrame(rows, "k string, i long, v double, extra string").repartition(5)
    got = order.running(d, ["k"], ["i"], F.col("i") + 1, "sum").collect()
    assert got[0].asDict().keys() == {"k", "i", "v", "extra", "sum"} and len(got) == len(rows)
    for q in got:
        assert q["sum"] == sum(i + 1 for k, i, _, _ in rows if k == q.k and i < q.i)
    for q in order.ranks(d, ["k"], "v").collect():
        mine = [v for k, _, v, _ in rows if k == q.k and v is not None]
        assert (q.below, q.equal, q.n) == (sum(v < q.v for v in mine), mine.count(q.v), len(mine))
    alone = {q.v: q.below for q in order.ranks(d, [], "v").collect()}
    values = [v for _, _, v, _ in rows if v is not None]
    assert alone == {v: sum(u < v for u in values) for v in set(values)}
    assert order.running(d.limit(0), ["k"], ["i"], F.lit(1)).count() == 0 and order.ranks(d.filter("v is null"), ["k"], "v").count() == 0


def test_pooled_line_from_group_sums(spark):
    from gridloom.operators import regress

    r = np.random.default_rng(8)
    rows = [(k, float(x), float(2 * x + k + r.normal())) for k in range(5) for x in r.normal(1e4, 1, 12)] + [(9, 3.0, 1.0), (8, 1.0, None)]
    d = spark.createDataFrame(rows, "k int, x double, y double")
    x, y = np.array([(x, y) for _, x, y in rows if y is not None]).T
    slope, intercept = np.polyfit(x - x.mean(), y, 1)
    got = {q.k: q for q in regress.ols_by(d, ["k"], "x", "y").collect()}
    for k in (8, 9):
        assert got[k].slope == pytest.approx(slope, rel=1e-9) and got[k].intercept == pytest.approx(intercept - slope * x.mean(), rel=1e-7, abs=1e-5) and got[k].r2 is None
    assert got[1].slope == pytest.approx(np.polyfit(*(lambda a: (a[:, 0] - 1e4, a[:, 1]))(np.array([(x, y) for k, x, y in rows if k == 1])), 1)[0], rel=1e-6)
