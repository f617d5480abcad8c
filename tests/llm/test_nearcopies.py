import numpy as np

import corpus_pipeline as cp
from gridloom.llm import nearcopies


def components_of(texts, least=(4, 5)):
    sets = {i: set(nearcopies.shingle_set(t, 5).tolist()) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in texts:
        for j in texts:
            both, all_ = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if j < i and both * least[1] >= least[0] * all_:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in texts}


def numbered(rng, n):
    return [f"w{k}" for k in rng.integers(0, 10**9, n)]


def test_recall_at_the_limit_and_above_and_no_false_link(frame):
    """300 pairs each of similarity 0.8 exactly, 239 / 300, and 0.9."""
    rng = np.random.default_rng(0)
    texts = {}
    for i in range(300):
        for at, keep in ((0, 244), (10_000, 243), (20_000, 274)):
            w = numbered(rng, 304)
            texts |= {at + i: " ".join(w), at + 1000 + i: " ".join(w[:keep])}
    got = {r.doc_id: r.component_id for r in nearcopies.near_copies(frame(list(texts.items()))).collect()}
    caught = lambda at: np.mean([got[at + 1000 + i] == at + i for i in range(300)])
    assert caught(0) >= 0.97 and caught(20_000) >= 0.99 and caught(10_000) == 0
    assert all(got[i] == i for i in got if i % 10_000 < 1000)


def test_plan_reaches_its_recall_for_any_number_of_texts():
    """The chance that a pair at the limit shares a cell within the radius, drawn anew for the planned search."""
    rng = np.random.default_rng(3)
    for texts in (200, 50_000, 10**7):
        radius, bits, tables = nearcopies.search_plan(texts)
        d = (rng.random((2000, 256)) < np.arccos(1.6 / 1.8) / np.pi).astype(np.int64)
        met = np.zeros(2000, bool)
        for _ in range(tables):
            met |= d[:, rng.choice(256, bits, replace=False)].sum(axis=1) == 0
        assert (met & (d.sum(axis=1) <= radius)).mean() >= 0.98


def test_dense_groups_equal_brute_force(frame):
    """Copies of one text changed in 1 to 9 places, and texts that hold half of it, in cells cut to small shards and batches."""
    rng = np.random.default_rng(1)
    base = [f"w{k}" for k in range(200)]
    texts = {}
    for i in range(120):
        w = list(base)
        for at in rng.choice(200, i % 9 + 1, replace=False):
            w[at] = f"x{rng.integers(0, 10**9)}"
        texts[i] = " ".join(w if i % 10 else base[:100] + numbered(rng, i + 1))
    texts |= {200: "", 201: None, 202: "One two", 203: "one TWO", 204: "one three"}
    want = components_of(texts)
    for options in ({}, {"shard": 16, "batch": 8}):
        assert {r.doc_id: r.component_id for r in nearcopies.near_copies(frame(list(texts.items())), **options).collect()} == want
    assert nearcopies.near_copies(frame([])).count() == 0


def test_nearest_forest_spans_what_all_edges_join():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 60, 90), rng.integers(0, 60, 90)

    def parts(*at):
        edges = list(zip(*at, strict=True))
        label = np.arange(60)
        for _ in range(60):
            for x, y in edges:
                label[x] = label[y] = min(label[x], label[y])
        return label.tolist()

    kept = nearcopies.nearest_forest(60, a, b)
    assert parts(a[kept], b[kept]) == parts(a, b) and len(kept) < 60


def test_stage_keeps_below_the_limit_and_drops_above_it(spark, sf, frame):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(40):
        w = numbered(rng, 304)
        rows += [(i, " ".join(w)), (100 + i, " ".join(w[: (290 if i % 2 else 230)]))]
    rows += [(300, "x y"), (300, "a b c"), (None, "x y"), (None, None)]
    out = cp.drop_near_duplicates(spark, frame(rows), sf).collect()
    assert {r.doc_id for r in out} == set(range(40)) | {100 + i for i in range(0, 40, 2)} | {300, None}
    assert [r.text for r in out if r.doc_id == 300] == ["a b c"] and sum(r.doc_id is None for r in out) == 2
