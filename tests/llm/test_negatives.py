"""Hard negatives against a plain sort of every pair."""

import math

import numpy as np
import pytest

from gridloom.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>, rank string, anchor_id int"


def plain(rows, positives=5, k=10):
    ok = {}
    for i, label, v in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0, r[2] or [])):
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ok.setdefault(i, (label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for a, (label, q) in ok.items():
        if a % 100:
            continue
        s = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), i, l) for i, (l, v) in ok.items() if i != a and len(v) == len(q))
        for n, p, _ in [x for x in s if x[2] == label][:positives]:
            fit = [(i, -m) for m, i, l in s if l != label and 30 * -n <= 100 * -m <= 90 * -n][:k]
            out += [(a, p, r, i, -n, m) for r, (i, m) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, **how):
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in negatives.mine_hard_negatives(d, **how).collect())


def vectors(n, seed, dim=6):
    r = np.random.default_rng(seed)
    return [(int(i), int(r.integers(4)), [float(x) for x in r.normal(0.5, 1, dim).astype(np.float32)]) for i in range(n)]


@pytest.mark.parametrize("how", [{}, {"block": 2, "room": 40, "k": 3, "positives": 2}])
def test_same_as_a_plain_sort(spark, how):
    rows = vectors(700, 1)
    rows += [(1000 + i, 1, rows[5][2]) for i in range(40)]  # ties
    got = mined(spark, rows, **how)
    assert got == plain(rows, how.get("positives", 5), how.get("k", 10)) and len(got) > 20


def test_nulls_lengths_and_repeated_rows(spark):
    rows = vectors(120, 2)
    rows += [rows[7], rows[7], (8, 3, [0.0] * 6), (None, 1, rows[3][2]), (200, None, rows[3][2]), (201, 1, None), (202, 1, [None] * 6), (203, 1, [float("nan")] * 6), (204, 1, [float("inf")] * 6), (205, 1, [1.0]), (300, 2, []), (301, 2, []), (302, 1, [])]
    assert mined(spark, rows) == plain(rows)


def test_no_rows_and_no_other_label(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(i, 1, [1.0, 2.0]) for i in range(5)]) == []


def test_large_components_are_exact():
    a, b = np.array([[2.0**40, 1.0]]), np.array([[2.0**22, 3.0], [2.0**40, 0.0]])
    assert negatives.scores(a, b).tolist() == [[2**62 + 3, 2**63 - 1]]
