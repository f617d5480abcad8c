"""The pipeline stage by stage against plain Python on the smallest tables."""

import collections

import corpus_pipeline as cp
from gridloom.llm import queries, toxicity
from gridloom.llm.common import table
from gridloom.llm.simhash import shingle_hashes


def test_stages_keep_columns_and_decide(spark, sf):
    docs = table(spark, sf, "documents")
    names = docs.columns
    stages = dict(cp.STAGES)
    assert list(stages) == ["toxicity", "line dedup", "near dedup", "decontamination", "mixing"]

    a = stages["toxicity"](spark, docs, sf).cache()
    toxic = {r.doc_id for r in toxicity.score_toxicity(docs, table(spark, sf, "labels")).filter("predicted = 1").collect()}
    assert a.columns == names and {r.doc_id for r in a.collect()} == {r.doc_id for r in docs.collect()} - toxic

    b = stages["line dedup"](spark, a, sf).cache()
    rows = {r.doc_id: r.text for r in a.collect()}
    of = collections.defaultdict(set)
    key = lambda x: x.encode().strip().lower().decode()
    for i, t in rows.items():
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                of[key(x)].add(i)
    gone = {k: max(v) for k, v in of.items() if len(v) >= 5}
    want = {i: "\n".join(x for x in (t or "").split("\n") if gone.get(key(x), i) == i) for i, t in rows.items()}
    got = {r.doc_id: r.text for r in b.collect()}
    assert b.columns == names and got == {i: t for i, t in want.items() if t == (rows[i] or "") or t.strip(" ")}

    c = stages["near dedup"](spark, b, sf).cache()
    kept = {r.doc_id for r in c.collect()}
    sets = {i: set(shingle_hashes(t, 5).tolist()) for i, t in got.items()}
    sim = lambda x, y: len(sets[x] & sets[y]) / max(1, len(sets[x] | sets[y]))
    assert c.columns == names and kept <= set(got)
    for i in set(got) - kept:
        assert any(sim(i, j) >= 0.6 for j in got if j < i)
    near = [(i, j) for i in kept for j in kept if j < i and sim(i, j) >= 0.85]
    assert not near

    d = stages["decontamination"](spark, c, sf).cache()
    tidy = lambda s: " ".join((s or "").split())
    items = [tidy(r.text) for r in table(spark, sf, "benchmark").collect()]
    assert {r.doc_id for r in d.collect()} == {r.doc_id for r in c.collect() if not any(t in tidy(r.text) for t in items)}

    e = stages["mixing"](spark, d, sf)
    assert e.count() == d.count() and {r.doc_id for r in e.collect()} == {r.doc_id for r in d.collect()}
    assert queries.queries() and cp.ORACLE_SQL is None
