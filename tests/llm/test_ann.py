import math

import numpy as np
from pyspark.sql import functions as F

from gridloom.llm import ann, queries
from gridloom.llm.common import table


def brute(rows, k=10):
    out = {}
    for q, v in rows:
        if q % 100 == 0:
            d = sorted((math.dist(v, x), i) for i, x in rows if i != q)
            out[q] = [i for _, i in d[:k]]
    return out


def test_recall_and_exact_scores(spark, sf):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in table(spark, sf, "embeddings").collect()]
    vectors, want = dict(rows), brute(rows)
    got = queries.op2_ann(spark, sf).collect()
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        assert math.isclose(r.score, math.dist(vectors[r.query_id], vectors[r.vec_id]), rel_tol=1e-12)
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert set(found) == set(want)
    assert sum(len(set(found[q]) & set(want[q])) for q in want) / sum(map(len, want.values())) >= 0.9


def test_hadamard_rotation_keeps_length():
    x = np.random.default_rng(0).normal(size=(5, 48))
    assert np.allclose(np.linalg.norm(ann.rotate(x, 1, 2, 0), axis=1), np.linalg.norm(x, axis=1))


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    copies = [(i, [1.0, 0.0]) for i in range(1, 40)]
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), *copies, (100, [0.0, 1.0]), (200, None), (300, [0.0, 0.0]), (400, [nan, 1.0]), (500, [inf, 1.0]), (600, [None, 1.0]), (700, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest_neighbours(d).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {0, 100}
    assert sorted(got[0]) == [(k, k, 0.0) for k in range(1, 11)]
    assert [v for _, v, _ in sorted(got[100])] == list(range(10))
    assert ann.nearest_neighbours(d.limit(0)).count() == 0


def recall_of(got, want):
    found = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(found) == set(want)
    return sum(len(found[q] & set(want[q])) for q in want) / sum(map(len, want.values()))


def share(plan, tables=8):
    """Rows that a query visits, if buckets were of one size."""
    return 1 - (1 - plan["probes"] / 2 ** plan["bits"]) ** tables


def planned(d):
    valid = d.select("vec_id", "embedding")
    index, asked = valid.select(F.array("vec_id").alias("ids"), "embedding"), valid.filter("vec_id % 100 = 0").select(F.array("vec_id").alias("ids"), "embedding")
    return ann.calibrated(index, asked, index.count(), 10, 8, 128, 0.95, 64, 3)


def test_measured_plans_reach_recall_and_visit_less_as_the_index_grows(spark):
    """Random vectors of 16 components, the hardest case: nothing is near."""
    shares = []
    for n in (400, 3000, 20000):
        x = np.random.default_rng(n).normal(size=(n, 16))
        d = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
        d = d.filter("vec_id % 100 != 0 or vec_id < 4000")  # 40 queries at most
        rows = [(i, list(r)) for i, r in enumerate(x) if i % 100 or i < 4000]
        plan = planned(d)
        assert plan["found"] >= 0.95
        shares.append(share(plan))
        q = np.array([r for i, r in rows if i % 100 == 0])
        ids = np.array([i for i, _ in rows])
        dist = ((q[:, None, :] - np.array([r for _, r in rows])[None]) ** 2).sum(axis=2)
        want = {i: ids[np.argsort(row)[1:11]].tolist() for i, row in zip(ids[ids % 100 == 0].tolist(), dist, strict=True)}
        assert recall_of(ann.nearest_neighbours(d, plan=plan).collect(), want) >= 0.9
    assert shares[0] > shares[1] > shares[2]


def test_several_functions_and_small_shards_agree_with_brute_force(spark):
    """Codes of more bits than one function has; probing all buckets must give the exact answer."""
    x = np.random.default_rng(4).normal(size=(300, 8))
    d = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    want = brute([(i, list(r)) for i, r in enumerate(x)])
    got = {}
    for r in ann.nearest_neighbours(d, plan={"bits": 6, "probes": 64}, tables=2, shard=16).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    assert {q: [got[q][k] for k in range(1, 11)] for q in got} == want
    assert ann.functions(6, 8) == [4, 2] and ann.functions(3, 64) == [3] and ann.functions(2, 1) == [1, 1]
    codes = ann.probe_codes(x, table=0, bits=6, probes=64, seed=3)
    assert all(sorted(c) == list(range(64)) for c in codes.tolist())


def test_clashing_columns_and_huge_values(spark):
    d = spark.createDataFrame([(i, [1e200 * (i + 1), 1e200]) for i in range(30)], "vec_id long, embedding array<double>")
    for c in ("ids", "bucket", "group", "n", "s", "rank", "query_id", "score", "large", "is_query"):
        d = d.withColumn(c, F.lit("x"))
    assert ann.nearest_neighbours(d).count() == 10


def test_probes_of_queries_are_not_broadcast(spark, monkeypatch):
    """They look as small as the queries to the planner, and would pass through the driver: 512 copies of each vector."""
    plans = {}

    def seen(df, name, stored=ann.stored):
        plans[name] = df._jdf.queryExecution().executedPlan().toString().splitlines()
        return stored(df, name)

    monkeypatch.setattr(ann, "stored", seen)
    x = np.random.default_rng(7).normal(size=(600, 8))
    d = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    assert ann.nearest_neighbours(d, plan={"bits": 4, "probes": 8}, shard=16).count() == 60
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for i, line in enumerate(plan := plans["found"]):
        if "BroadcastExchange" in line:
            below = plan[i + 1 :]
            end = next((j for j, x in enumerate(below) if depth(x) <= depth(line)), len(below))
            assert not any("MapInArrow" in x for x in below[:end])
    assert any("SortMergeJoin" in x for x in plan)
