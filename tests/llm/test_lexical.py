"""Ranked search against scoring every document with every term."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from gridloom.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def split(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=50):
    tf = [(i, Counter(split(t))) for i, t in docs]
    tf = [(i, c) for i, c in tf if c]
    n, total, df = len(tf), sum(sum(c.values()) for _, c in tf), Counter(t for _, c in tf for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(split(t))
    out = []
    for item, terms in asked.items():
        found = []
        for i, c in tf:
            m = 50 + 50 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0 and i is not None:
                found.append((-s, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def ranked(spark, docs, items, **how):
    d = spark.createDataFrame([(*r, 1, "s") for r in docs], "doc_id long, text string, item_id int, score string")
    q = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    return sorted(tuple(r) for r in lexical.search_documents(d, q, **how).collect())


def corpus(n, seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = [(i, " ".join(r.choices(words, weights, k=int(r.expovariate(0.05))))) for i in range(n)]
    items = [(i, ", ".join(r.choices(words, k=r.randint(1, 12)))) for i in range(15)]
    return docs, items


@pytest.mark.parametrize("how", [{}, {"k": 3, "block": 300}])
def test_same_as_scoring_everything(spark, how):
    docs, items = corpus(400, 1)
    docs += [(1000 + i, docs[3][1]) for i in range(30)]  # ties
    got = ranked(spark, docs, items, **how)
    assert got == plain(docs, items, how.get("k", 50)) and len(got) > 40


def test_shards_prune_and_agree(spark, monkeypatch):
    docs, items = corpus(300, 2)
    rows = []
    for size in (1 << 12, 300):
        run = lexical._postings(type("V", (), {"value": {t.encode(): n for n, t in enumerate(sorted({t for _, x in items for t in split(x)}))}})())
        monkeypatch.setattr(lexical, "SHARD", size)
        b = pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs], pa.int64()), pa.array([t.encode() for _, t in docs], pa.binary())], names=["doc_id", "text"])
        rows.append(list(run(iter([b]))))
    assert len(rows[1]) > len(rows[0]) > 1


def test_nulls_signs_and_repeated_rows(spark):
    docs = [(1, None), (2, ""), (3, " .,;"), (4, "One two-two THREE"), (4, "One two-two THREE"), (None, "one one one"), (5, "été ÉTÉ 3x3"), (6, "one\x00two\nthree" * 50)]
    items = [(1, "one TWO"), (1, "three three"), (2, None), (3, "..."), (None, "one"), (4, "ÉTÉ 3x3"), (5, "absent"), (6, "one")]
    got = ranked(spark, docs, items)
    assert got == plain(docs, items)
    assert [x for x in got if x[0] == 6 and x[2] is None] == []


def test_long_texts_are_split_whole(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SLICE", 50)
    raw = ("alpha beta-gamma " * 40).encode()
    assert [t for part in lexical.terms_of(raw) for t in part] == [t.encode() for t in split(raw.decode())]


def test_empty_tables(spark):
    assert ranked(spark, [], [(1, "one")]) == []
    assert ranked(spark, [(1, "one")], []) == []
    assert ranked(spark, [(1, None)], [(1, "one")]) == []
