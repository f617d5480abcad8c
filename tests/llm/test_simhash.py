import numpy as np
import xxhash

from gridloom.llm import queries, simhash
from gridloom.llm.common import table


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    ones = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if ones[b] * 2 > len(grams)) if grams else 0


def brute_components(fps, radius):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if bin(fps[a] ^ fps[b]).count("1") <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_query_equals_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    comp = brute_components(fps, 4)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op1_simhash(spark, sf).collect()}
    assert got == {i: (f"{fps[i]:016x}", comp[i]) for i in texts}


def test_links_survive_sharding(spark):
    """Small shards force cells to be cut again and then dealt over several trees."""
    rng = np.random.default_rng(2)
    centre = [int(x) for x in rng.integers(0, 2**63, 4)]
    fps = {}
    for i in range(240):
        f = centre[i % 4]
        for b in rng.choice(64, int(rng.integers(0, 5)), replace=False):
            f ^= 1 << int(b)
        fps.setdefault(f, i)
    rows = [(f - (1 << 64) if f >> 63 else f, i) for f, i in fps.items()]
    nodes = spark.createDataFrame(rows, "fp long, node long")
    want = brute_components({i: f for f, i in fps.items()}, 4)
    for options in ({"shard": 8}, {"shard": 8, "batch": 16, "cuts": 1}):
        got = {r.u: r.component for r in simhash.components(simhash.link_fingerprints(nodes, radius=4, **options)).collect()}
        assert {i: got.get(i, i) for i in want} == want


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(60)], "u long, v long")
    assert {r.component for r in simhash.components(edges).collect()} == {0}
    assert simhash.components(edges.limit(0)).count() == 0


def test_edge_cases(frame):
    long = "word " * 70000
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (4, "One"), (None, "One"), (5, long), (6, long.upper()), (7, "a b c d e f")]
    got = simhash.near_duplicates(frame(rows)).collect()
    assert len(got) == len(rows)
    comp = {r.doc_id: r.component_id for r in got}
    assert comp[1] == comp[2] == comp[3] == 1 and comp[6] == 5 and comp[4] == 4 and comp[None] is None
    assert simhash.near_duplicates(frame([])).count() == 0
