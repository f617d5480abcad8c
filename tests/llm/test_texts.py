"""Row-wise and counting operators against brute force and on edge cases."""

import collections
import hashlib
import math
import re
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, linededup, lm, mixing, queries, secrets, substrings, toxicity, urlfilter
from gridloom.llm.common import table

EDGE = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (4, "One two"), (None, "x y"), (5, "Ünï " * 30000)]


def texts_of(spark, sf):
    return {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}


# Toxicity --------------------------------------------------------------------


def test_toxicity_ranks_held_out_labels(spark, sf):
    got = {r.doc_id: r for r in queries.op3_toxicity(spark, sf.replace("sf0.001", "sf0.01")).collect()}
    labels = table(spark, sf.replace("sf0.001", "sf0.01"), "labels").collect()
    held = [(got[r.doc_id].score, r.toxic) for r in labels if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    pos, neg = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert auc > 0.85 and np.mean([s >= 0.3 for s in neg]) < 0.1


def test_tokens_are_made_a_few_texts_at_a_time():
    """Same tokens as at once, with a peak of a few times the texts; the driver's sample is tokenised whole otherwise."""
    r = np.random.default_rng(5)
    texts = [None, "", *[" ".join(f"w{x}" for x in r.integers(0, 10**6, r.integers(0, 400))) for _ in range(1500)]]
    tracemalloc.start()
    got = toxicity.tokenise(texts)
    kept, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 3 * kept
    want = toxicity.tokens_of([toxicity.split_words(t) for t in texts])
    assert all(np.array_equal(getattr(got, k), getattr(want, k)) and getattr(got, k).dtype == getattr(want, k).dtype for k in ("word", "gram", "start", "size", "lens"))
    assert not len(toxicity.tokenise([]).lens)


def test_toxicity_gradients():
    net = toxicity.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    t = toxicity.tokenise(["one two three", "four " * 40])
    index = toxicity.window_index(t.lens)[0]
    y = np.arange(len(index)) % 2

    def loss():
        z = net.logits(net.vectors(t), index)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    tape = {}
    z = net.logits(net.vectors(t), index, tape)
    g = net.gradients(tape, (1 / (1 + np.exp(-z)) - y) / len(y), t, None)
    for key in ("Wf", "Ub", "cf", "att", "out", "bias", "gram", "word"):
        at = np.unravel_index(np.argmax(np.abs(g[key])), g[key].shape)
        eps, keep = 1e-3, net.p[key][at]
        net.p[key][at] = keep + eps
        up = loss()
        net.p[key][at] = keep - eps
        down = loss()
        net.p[key][at] = keep
        assert (up - down) / (2 * eps) == pytest.approx(g[key][at], rel=0.05, abs=1e-5)


def test_toxicity_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 56, 57, 500):
        t = toxicity.tokenise(["w " * n, "tail"])
        index, text = toxicity.window_index(t.lens)
        seen = set(index[text == 0].ravel().tolist()) - {-1}
        assert seen == set(range(n))


def test_toxicity_edge_cases(frame, spark):
    labels = spark.createDataFrame([(4, 1, None), (2, 0, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(frame(EDGE), labels).collect()
    assert len(got) == len(EDGE) and {r.score for r in got} == {0.0} and {r.predicted for r in got} == {0}
    some = spark.createDataFrame([(4, 1), (1, 0), (5, 0)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(frame(EDGE), some).collect()
    assert len(got) == len(EDGE) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score_toxicity(frame([]), some).count() == 0


def plain_score(net, text):
    """The network word by word, in plain Python."""
    p = {k: v.astype(float) for k, v in net.p.items()}
    n, sig = toxicity.HIDDEN, lambda x: 1 / (1 + np.exp(-x))
    words = (text or "").encode().lower().split()

    def vector(w):
        t = toxicity.tokenise([w.decode()])
        return np.concatenate([p["word"][t.word[0]], np.mean([p["gram"][g] for g in t.gram], axis=0)])

    def states(xs, k):
        h, out = np.zeros(n), []
        for x in xs:
            a, b = x @ p[f"W{k}"] + p[f"c{k}"], h @ p[f"U{k}"]
            z, r = sig(a[:n] + b[:n]), sig(a[n : 2 * n] + b[n : 2 * n])
            c = np.tanh(a[2 * n :] + r * b[2 * n :])
            h = (1 - z) * c + z * h
            out.append(h)
        return out

    def logit(window):
        if not window:
            return p["bias"][0]
        xs = [vector(w) for w in window]
        h = np.concatenate([states(xs, "f"), states(xs[::-1], "b")[::-1]], axis=1)
        e = np.exp(h @ p["att"])
        return (e / e.sum()) @ h @ p["out"] + p["bias"][0]

    windows = [words[a : a + toxicity.WINDOW] for a in range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE)]
    return sig(net.scale * max(map(logit, windows)) + net.shift)


def test_toxicity_scores_equal_a_plain_forward_pass(monkeypatch):
    net = toxicity.Network(5)
    net.scale, net.shift = 1.7, -0.2
    rng = np.random.default_rng(1)
    texts = [None, "", "One", "a " * 33, *[" ".join(rng.choice(["ab", "Ünï", "words", "x1"], n)) for n in (7, 32, 57, 300)]]
    want = [plain_score(net, t) for t in texts]
    assert np.allclose(net.score(texts), want, atol=1e-5)
    monkeypatch.setattr(toxicity, "PIECE", 2)  # long texts in many pieces
    assert np.allclose(net.score(texts), want, atol=1e-5)


def test_toxicity_learns_from_negative_and_repeated_ids(frame, spark):
    bad, good = "you awful vile creature " * 60, "a calm and sunny day " * 60
    rows = [(-i, bad if i % 2 else good) for i in range(1, 30)] + [(-1, bad)] * 20
    labels = spark.createDataFrame([(-i, i % 2) for i in range(1, 30)] * 2, "doc_id long, toxic int")
    net = toxicity.fit(frame(rows), labels, steps=60)
    a, b = net.score([bad, good])
    assert a > 0.5 > b


# Language model --------------------------------------------------------------


def brute_lm(texts, order):
    """A plain interpolated modified Kneser-Ney model."""
    tok = lambda t: (t or "").encode().lower().split() + [b"\n"]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    grams = lambda w: [tuple(([None] * (order - 1) + w)[k : k + order]) for k in range(len(w))]
    uni, counts = collections.Counter(), {order: collections.Counter()}
    for i, t in texts:
        if not held(i):
            uni.update(tok(t))
            counts[order].update(grams(tok(t)))
    for n in range(order - 1, 0, -1):
        counts[n] = collections.Counter(g[1:] for g in counts[n + 1])
    d = {n: lm.discounts(*[sum(c == k for c in counts[n].values()) for k in (1, 2, 3, 4)]) for n in counts}
    total, mass = collections.Counter(), collections.Counter()
    for n, of in counts.items():
        for g, c in of.items():
            total[n, g[:-1]] += c
            mass[n, g[:-1]] += d[n][min(c, 3) - 1]
    v = len(uni)

    def p(g):
        n = len(g)
        low = p(g[1:]) if n > 1 else 1 / (v + 1)
        t = total[n, g[:-1]]
        c = counts[n][g]
        return (max(c - (0, *d[n])[min(c, 3)], 0) + mass[n, g[:-1]] * low) / t if t else low

    out, n = {}, sum(uni.values())
    for i, t in texts:
        w = tok(t)
        out[i] = (held(i), len(w), sum(x in uni for x in w), n, sum(math.log10((uni[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), sum(math.log10(p(g)) for g in grams(w)))
    return out


@pytest.mark.parametrize(("order", "buckets"), [(3, None), (3, 19), (2, 5)])
def test_lm_equals_plain_model(spark, sf, order, buckets):
    """With more buckets, frequent words are spread and files hold several buckets."""
    docs = table(spark, sf, "documents").filter("doc_id < 60")
    want = brute_lm([(r.doc_id, r.text) for r in docs.collect()], order)
    rows = lm.kneser_ney_scores(docs, order=order, buckets=buckets, hot=0.5).collect()
    assert len(rows) == len(want)
    for r in rows:
        h, n, known, total, base, score = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, n, known, total)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)


def test_lm_edge_cases(frame):
    got = lm.kneser_ney_scores(frame(EDGE)).collect()
    assert len(got) == len(EDGE) and all(math.isfinite(r.score) for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1}
    lone = lm.kneser_ney_scores(frame([(None, "a b")])).collect()
    assert [(r.held_out, r.n_tokens, r.train_tokens, r.score) for r in lone] == [(True, 3, 0, 0.0)]
    assert lm.kneser_ney_scores(frame([])).count() == 0


# Mixing ----------------------------------------------------------------------


def test_mixing_comes_near_its_targets(spark, sf):
    rows = queries.op5_mixing(spark, sf).collect()
    by = collections.defaultdict(lambda: [0, 0, 0.0])
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        by[r.source][0] += r.taken
        by[r.source][1:] = [r.source_size, r.target]
    total = sum(s for _, s, _ in by.values())
    assert sum(t for *_, t in by.values()) == pytest.approx(total)
    for taken, size, target in by.values():
        assert target <= 3 * size and abs(taken - target) <= 256
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.op5_mixing(spark, sf).collect()))


def test_sainte_lague_equals_highest_quotients(spark):
    rng = np.random.default_rng(5)
    for seats in (0, 1, 7, 100):
        votes = [int(v) for v in rng.integers(0, 1000, 12)]
        d = spark.createDataFrame([(1, i, float(v), seats) for i, v in enumerate(votes)], "g int, k long, v double, s long")
        q = sorted(((-v / (2 * n - 1), i, n) for i, v in enumerate(votes) for n in range(1, seats + 1) if v), key=lambda x: x)[:seats]
        want = collections.Counter(i for _, i, _ in q)
        assert {r.k: r.quota for r in mixing.sainte_lague(d, ["g"], "k", "v", "s").collect()} == {i: want[i] for i in range(12)}


def test_mixing_edge_cases(spark):
    rows = [(1, None, "a"), (2, "x y z", None), (2, "x y z", None), (None, "w " * 500, "b"), (4, "", "b")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(d).collect()
    assert len(got) == 5 and {(r.source, r.source_size) for r in got} == {("a", 0), ("b", 500), (None, 6)}
    assert mixing.mix_sources(d.limit(0)).count() == 0
    assert [r.taken for r in mixing.mix_sources(d.filter("size(split(text, 'x')) > 9")).collect()] == []


def test_grams_are_sent_in_order_of_both_words():
    r = np.random.default_rng(2)
    bucket, w2, w1 = (r.integers(0, n, 500).astype(np.uint32) for n in (3, 7, 90))
    by = lm.sending_order(bucket, w2, w1)
    assert list(zip(bucket[by], w2[by], w1[by], strict=True)) == sorted(zip(bucket, w2, w1, strict=True))


# URLs ------------------------------------------------------------------------


def test_urls(spark):
    urls = [None, "", "example.com/en/", "HTTP://A.Example.COM/en/7?x#y", "http://x.com/en/1", "ftp://com/en/", "http://notcom/en/", "http://É.net/de/8", "http://www.example.net/de/81", "http://o.org?q=/es/", "http://o.org/es/#f", "a://b://c/d"]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string")
    none = spark.createDataFrame([], "page_id long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge_urls(pages, none).collect()}
    assert got == {
        0: ("", "", None, "allow"),
        1: ("", "", None, "allow"),
        2: ("", "", None, "allow"),
        3: ("a.example.com", "/en/7", "example.com/en/7", "allow"),
        4: ("x.com", "/en/1", "com/en/", "block"),
        5: ("com", "/en/", "com/en/", "block"),
        6: ("notcom", "/en/", None, "allow"),
        7: ("É.net", "/de/8", "net/de/", "block"),
        8: ("www.example.net", "/de/81", "example.net/de/8", "allow"),
        9: ("o.org", "", None, "allow"),
        10: ("o.org", "/es/", "org/es/", "block"),
        11: ("b:", "//c/d", None, "allow"),
    }
    assert urlfilter.judge_urls(pages.limit(0), none).count() == 0


def test_url_rules_allow_net_and_block_its_exception(spark):
    pages = spark.createDataFrame([(1, "http://a.net/de/1", ""), (2, "http://example.net/de/81", "")], "page_id long, url string, html string")
    none = spark.createDataFrame([], "page_id long, bad int")
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge_urls(pages, none).collect()}
    assert got == {1: ("net/de/", "allow"), 2: ("example.net/de/8", "block")}


def test_reputation_needs_evidence(spark):
    rows = [(i, f"http://bad.site.info/{i}") for i in range(40)] + [(100 + i, f"http://good{i % 20}.info/{i}") for i in range(200)] + [(900, "http://once.other.biz/"), (901, "http://new.site.info/")]
    pages = spark.createDataFrame([(i, u, "") for i, u in rows], "page_id long, url string, html string")
    bad = spark.createDataFrame([(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(200)] + [(900, 1)], "page_id long, bad int")
    got = {r.page_id: r for r in urlfilter.judge_urls(pages, bad).collect()}
    assert {got[i].verdict for i in range(40)} == {"block"} and {got[100 + i].verdict for i in range(200)} == {"allow"}
    assert got[900].verdict == "allow" and got[900].bad_rate > got[100].bad_rate


# Lines -----------------------------------------------------------------------


def test_line_dedup_is_exact_on_every_path(spark, sf):
    """A full filter; a filter and keys too large to broadcast, in several slices."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    docs = docs.union(docs.filter("doc_id % 40 = 0"))  # repeated rows
    a = linededup.dedup_lines(docs).orderBy("doc_id", "text").collect()
    assert sum(r.n_dropped for r in a)
    assert a == linededup.dedup_lines(docs, bits_per_line=1e-9).orderBy("doc_id", "text").collect()
    assert a == linededup.dedup_lines(docs, bits_per_line=3000, broadcast_bytes=0).orderBy("doc_id", "text").collect()


def test_line_filters_follow_the_lines(frame):
    d = frame([(i, "\n".join(f"{i} {k} " + "x" * 60 for k in range(500))) for i in range(40)])
    assert linededup.filter_bits(d, 40, 16) == linededup.SLICE_BITS and linededup.filter_bits(d, 40, 160) == 7 * linededup.SLICE_BITS


def test_line_dedup_edge_cases(frame):
    line = "x" * 40
    rows = [*EDGE, *[(10 + i, f"keep {i}\n {line.upper()}\t") for i in range(5)], (14, f"{line}\n{line}"), (None, line)]
    got = linededup.dedup_lines(frame(rows)).collect()
    assert len(got) == len(rows)
    texts = {(r.doc_id, r.n_lines, r.n_dropped): r.text for r in got}
    assert texts[10, 2, 1] == "keep 0" and texts[14, 2, 0] in (f"{line}\n{line}", f"keep 4\n {line.upper()}\t")
    assert texts[None, 1, 0] in (line, "x y") and texts[1, 1, 0] is None
    assert linededup.dedup_lines(frame([])).count() == 0
    short = [(i, "y" * 39) for i in range(9)]
    assert {r.n_dropped for r in linededup.dedup_lines(frame(short)).collect()} == {0}


# Secrets ---------------------------------------------------------------------


def brute_secrets(text):
    text = text or ""
    spans = []
    pattern = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    spans += [(m.start(), m.end(), "assign") for m in pattern.finditer(text) if len(m.group(2)) >= 6]
    spans += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    spans += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    spans.sort(key=lambda s: (s[0], ["assign", "access", "hex"].index(s[2])))
    n = collections.Counter(k for *_, k in spans)
    return n["assign"], n["access"], n["hex"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans).encode()).hexdigest()


def brute_entropy(text):
    """Spans by the definition of entropy, window by window."""
    bits = lambda s: -sum(c / len(s) * math.log2(c / len(s)) for c in collections.Counter(s).values())
    out = []
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
        if any(p.fullmatch(m[0]) for p in secrets.ALLOW):
            continue
        at = m.start()
        for piece in re.split("\0+", secrets.PARTS.sub(lambda x: "\0" * len(x[0]), m[0])):
            at = text.index(piece, at)
            hit = [k for k in range(len(piece) - 19) if bits(piece[k : k + 20]) >= secrets.THRESHOLDS[secrets.char_class(piece)] - 1e-9]
            out += [f"entropy:{at + hit[0]}:{at + hit[-1] + 20}"] if hit else []
            at += len(piece)
    return out


def test_secrets_equal_brute_force(spark, sf):
    texts = texts_of(spark, sf)
    rows = queries.op8_secrets(spark, sf).collect()
    assert {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in rows} == {i: brute_secrets(t) for i, t in texts.items()}
    spans = {r.doc_id: [x for x in r.spans.split(",") if x.startswith("entropy")] for r in rows}
    assert spans == {i: brute_entropy(t or "") for i, t in texts.items()}


def test_entropy_by_counts_equals_entropy_by_definition():
    def plain(s, w=20):
        hit = [k for k in range(len(s) - w + 1) if -sum(c / w * math.log2(c / w) for c in collections.Counter(s[k : k + w]).values()) >= secrets.THRESHOLDS[secrets.char_class(s)] - 1e-9]
        return (hit[0], hit[-1] + w) if hit else None

    rng = np.random.default_rng(0)
    assert secrets.entropy_span("a" * 21) is None
    for _ in range(200):
        s = "".join(rng.choice(list("abcdefghijKLMNOP0123456789+/")[: int(rng.integers(1, 28))], int(rng.integers(20, 90))))
        assert secrets.entropy_span(s) == plain(s)
        text = f"ü {s} and/{s[:30]}example{s}-sample-{s} {s}{'z' * 9}{s}"
        assert [f"{k}:{a}:{b}" for a, b, k in secrets.entropy_spans(text)] == brute_entropy(text)


def test_secret_kinds_and_allow_list():
    n, _, _, _, spans = secrets.scan_text("ü API_KEY = 'abc123' and kX9vQ2mZr7Lp4Wn8Tb3Yc6Hd1 end")
    assert n == 1 and spans == "assign:2:19,entropy:25:50"
    assert secrets.scan_text("example0123456789example0123456789")[4] == ""
    assert secrets.scan_text("ſecret=abcdefgh")[0] == 0
    key = "kX9vQ2mZr7Lp4Wn8Tb3Yc6Hd1"
    at = lambda text: secrets.scan_text(text)[4]
    assert at(f"path/sample/{key}") == "entropy:11:37" and at(f"{key[:12]}sample{key[12:]}") == "entropy:0:31"
    assert at(f"{key}AAAAAAAAAA{key}") == "entropy:0:25,entropy:35:60"
    assert at("3f2b8c1d-9e4a-4b7c-8d2e-1f6a5b9c0e7d") == at("sha256-" + key) == at("plain/words/and-more_of-them") == at("example-" * 5) == ""
    assert secrets.scan_text(None) == (0, 0, 0, hashlib.sha256(b"").hexdigest(), "")


def test_secrets_edge_cases(frame):
    assert secrets.scan_secrets(frame(EDGE)).count() == len(EDGE)
    assert secrets.scan_secrets(frame([])).count() == 0


# Substrings ------------------------------------------------------------------


def brute_substrings(docs, width=100):
    seen, out = set(), {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            s = b[p : p + width]
            if s in seen:
                gone[p : p + width] = b"\1" * width
            seen.add(s)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def rows_of(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_substrings_equal_brute_force(spark, sf):
    assert rows_of(queries.op9_substrings(spark, sf)) == brute_substrings(texts_of(spark, sf).items())


def test_substrings_of_periodic_and_overlapping_texts(frame):
    rng = np.random.default_rng(8)
    letters = "".join(rng.choice(list("abcd ü"), 900))
    docs = [(0, "a" * 1000), (1, "ab" * 300), (2, letters), (3, letters[50:400] + "ZZ" + letters[300:700]), (4, "b" + "ab" * 200), (5, letters[:99]), (6, letters[:100]), (7, "a" * 99), (8, None), (9, "xyz" * 100 + letters[600:] + "xyz" * 100)]
    assert rows_of(substrings.dedup_substrings(frame(docs))) == brute_substrings(docs)


def test_substrings_in_many_small_pieces(frame, monkeypatch):
    """Small pieces take the paths of hot anchors: ranges of hashes, and combining before sending."""
    rng = np.random.default_rng(11)
    passage = "".join(rng.choice(list("abcdefgh "), 400))
    docs = [(i, passage[: 150 + i] + "".join(rng.choice(list("xyz "), 120)) + passage[i * 7 :]) for i in range(40)] + [(100 + i, passage) for i in range(20)]
    n, doc, start, width = np.array([76] * 9), np.arange(9), np.zeros(9, np.int64), 100
    raw = np.concatenate([np.frombuffer((passage[:170] + str(i % 3) * 5).encode(), np.uint8) for i in range(9)])
    args = (np.ones(9, np.uint64), doc, start, n, np.arange(9) * 175, raw, width)
    whole = sorted(zip(*(x.tolist() for x in next(substrings.repeated_windows(*args))), strict=True))
    monkeypatch.setattr(substrings, "PIECE", 300)
    parts = list(substrings.repeated_windows(*args))
    assert len(parts) > 1 and sorted(p for d, at in parts for p in zip(d.tolist(), at.tolist(), strict=True)) == whole
    assert rows_of(substrings.dedup_substrings(frame(docs))) == brute_substrings(docs)


def test_substrings_edge_cases(frame):
    got = substrings.dedup_substrings(frame(EDGE), with_text=True).collect()
    assert len(got) == len(EDGE)
    assert {bytes(r.kept) for r in got if r.doc_id is None} == {b"x y"}
    assert substrings.dedup_substrings(frame([])).count() == 0
    twins = substrings.dedup_substrings(frame([(1, "q" * 99 + "r" * 99), (1, "q" * 99 + "r" * 99)])).collect()
    assert [r.n_removed for r in twins] == [0, 0]


# Decontamination -------------------------------------------------------------


def test_leaks_equal_containment(spark, sf):
    tidy = lambda s: " ".join((s or "").split())
    docs = {i: tidy(t) for i, t in texts_of(spark, sf).items()}
    items = {r.item_id: tidy(r.text) for r in table(spark, sf, "benchmark").collect()}
    want = {(d, i) for i, t in items.items() for d, x in docs.items() if t in x}
    assert {(r.doc_id, r.item_id) for r in queries.op10_decontaminate(spark, sf).collect()} == want


ITEM = "If the farmer John sold 12 apples at 3 dollars each and later bought 12 more while Mary watched, how much did John have left?"


def test_reparameterised_items_are_caught_if_slots_agree(spark, frame):
    bench = spark.createDataFrame([(7, ITEM), (8, None), (9, "too short")], "item_id long, text string")
    same = "Intro words. " + ITEM.replace("John", "Pedro").replace("Mary", "Anna").replace("12", "450").replace("3 dollars", "7 euros") + " More words follow."
    torn = ITEM.replace("12 apples", "450 apples").replace("John", "Pedro", 1)
    docs = frame([(1, same), (2, torn), (3, ITEM), (4, "Nothing of the kind is written in this short text at all."), (5, None), (None, ITEM), (6, ITEM), (6, ITEM)])
    got = {r.doc_id: r for r in decontaminate.find_leaks(docs, bench).collect()}
    assert {1, 3, 6} <= set(got) and not {2, 4, 5} & set(got)
    assert got[1].n_slots >= 4 and {r.item_id for r in got.values()} == {7}
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == 0
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0


def test_short_literal_and_case_changed_items_are_found(spark, frame):
    items = ["Who wrote the novel Moby Dick?", "Paris, London, Berlin, Madrid, Rome, Vienna, Prague, Lisbon, Oslo", "In 1912 the painter Pablo met Georges and Fernande in Paris with Max and Guillaume", " \n"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = frame([(0, f"Quiz. {items[0]} Answer below."), (1, f"We saw {items[1]} and more."), (2, f"so {items[2].lower()} again"), (3, ""), (4, "who wrote the novel about Moby and Dick"), (5, None)])
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()} == {(0, 0), (1, 1), (2, 2)}


def test_names_at_starts_inserted_words_and_merged_values(spark, frame):
    shop = "Alice has 3 apples and buys 5 more apples from the shop. Alice gives 2 apples to Bob. How many apples are left?"
    plain = "the quick brown fox jumps over a lazy dog while seven old sailors watch them from behind some tall wooden fence tonight"
    bench = spark.createDataFrame([(0, shop), (1, plain), (2, ITEM)], "item_id long, text string")
    other = shop.replace("Alice", "Carol").replace("Bob", "Dave").replace("3", "7").replace("5", "9").replace("2", "6")
    inserted = plain.replace(" seven", " about seven")
    merged = shop.replace("3", "4").replace("5", "4")
    units = ITEM.replace("3 dollars", "1 dollar").replace("John", "Pedro")
    torn = other.replace("Carol gives", "Erna gives")
    docs = frame([(0, f"Story. {other} End."), (1, f"well {inserted} ok"), (2, merged), (3, units), (4, torn), (5, "Alice has a shop.")])
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()} == {(0, 0), (1, 1), (2, 0), (3, 2)}


def test_plans_do_not_spell_out_the_benchmark(spark, frame, capsys):
    """The driver keeps the texts of plans: they may not grow with the benchmark."""
    words = lambda i, n: " ".join(f"word{i}x{k}" for k in range(n))
    items = decontaminate._items(spark.createDataFrame([(i, words(i, 40)) for i in range(40)], "item_id long, text string"), 8, 5)
    docs = frame([(1, f"so {words(3, 40)} it is"), (2, "nothing of the kind"), (3, None), (4, words(7, 8))])
    met = decontaminate._met(docs, decontaminate.stored(decontaminate._grams(items, [8]), "grams"), [8], True)
    met.explain(True)
    assert len(capsys.readouterr().out) < 40_000
    assert collections.Counter(r.doc_id for r in met.collect()) == {1: 33, 4: 1}


def test_extra_columns_do_no_harm(frame, spark):
    d = frame(EDGE + [(11, ITEM)]).withColumn("size", F.lit("x")).withColumn("rank", F.lit(1)).withColumn("key", F.lit(2)).withColumn("keys", F.lit(3)).withColumn("fp", F.lit(4)).withColumn("n_lines", F.lit("n")).withColumn("bucket", F.lit(0)).withColumn("score", F.lit(0)).withColumn("h", F.lit(0)).withColumn("item_id", F.lit(1)).withColumn("held_out", F.lit(1)).withColumn("l_id", F.lit(1))
    bench = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    assert linededup.dedup_lines(d).count() == mixing.mix_sources(d).count() == substrings.dedup_substrings(d).count() == lm.kneser_ney_scores(d).count() == len(EDGE) + 1
    assert decontaminate.find_leaks(d, bench).count() == 1
    labels = spark.createDataFrame([(4, 1)], "doc_id long, toxic int")
    assert toxicity.score_toxicity(d, labels, keep=True).columns[-3:] == ["text", "score", "predicted"]


def test_keys_are_looked_up_in_order(monkeypatch):
    """Each bucket's keys go through its array once, from front to back."""
    r = np.random.default_rng(6)
    keys = r.integers(0, 1 << 62, 5000).astype(np.uint64)
    tables = [lm._table("pair", keys[b::2], {"n": np.arange(1, 2501) % 300 + 1}) for b in (0, 1)]
    model = lm.Model("unused", 2)
    monkeypatch.setattr(model.files, "get", lambda kind, b, name, dtype: tables[b].get(name, np.empty(0, dtype)).astype(dtype))
    asked, search = [], np.searchsorted
    monkeypatch.setattr(lm.np, "searchsorted", lambda a, v, *x, **y: asked.append(np.array(v)) or search(a, v, *x, **y))
    mixed = r.permutation(5000)
    got = model.look_up("grams", mixed % 2, "pair", keys[mixed], ("n",))[0]
    assert got.tolist() == ((mixed // 2 + 1) % 300 + 1).tolist()
    wide = [v for v in asked if v.size > 1000]
    assert len(wide) == 2 and all((np.diff(v.astype(np.int64)) >= 0).all() for v in wide)


@pytest.mark.parametrize("order", [3, 2])
def test_messages_for_several_buckets_hold_the_same_model(spark, sf, order, monkeypatch):
    monkeypatch.setattr(lm, "LANES", 2)
    docs = table(spark, sf, "documents").filter("doc_id < 60")
    want = brute_lm([(r.doc_id, r.text) for r in docs.collect()], order)
    assert lm.Model("unused", 19).lane == 8
    rows = lm.kneser_ney_scores(docs, order=order, buckets=19, hot=0.5).collect()
    assert len(rows) == len(want)
    for r in rows:
        h, n, known, total, base, score = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, n, known, total)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)


def test_messages_do_not_grow_with_the_square_of_the_buckets(spark, sf, monkeypatch):
    """A task of many buckets sends each other bucket one message of a kind, not one from each of its buckets."""
    sent = {}

    def seen(df, name, stored=lm.stored):
        out = stored(df, name)
        sent[name] = out.filter("dest >= 0").count()
        return out

    monkeypatch.setattr(lm, "stored", seen)
    docs = table(spark, sf, "documents").filter("doc_id < 60")
    lm.train(docs, buckets=100, hot=0.5)
    tasks, kinds = 4, 4
    assert 0 < sent["gram_counts"] <= tasks * kinds * 100
    assert 0 < sent["hot_counts"] <= tasks * kinds * 100
