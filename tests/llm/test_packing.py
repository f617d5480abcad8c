"""Packing: the same bins as placing one piece after the other, ids as of whole texts, every token in one place."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridloom.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def one_by_one(lengths, capacity):
    """Remaining capacities of best-fit decreasing, by looking at every bin."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [(left, i) for i, left in enumerate(bins) if left >= n]
        if fit:
            bins[min(fit)[1]] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_fit_decreasing(seed):
    r = random.Random(seed)
    capacity = r.choice([1, 7, 20, 64, 100])
    lengths = [min(capacity, 1 + int(r.expovariate(1 / r.choice([2, 10, 40])))) for _ in range(r.choice([0, 1, 50, 700]))]
    plan = packing.best_fit(Counter(lengths), capacity)
    taken, ranks = {}, Counter()
    for length, first, sequence, each, offset in plan:
        assert first == ranks[length]
        later = [p[1] for p in plan if p[0] == length and p[1] > first]
        n = min(later, default=Counter(lengths)[length]) - first
        for j in range(n):
            taken.setdefault(sequence + j // each, []).append((offset + j % each * length, length))
        ranks[length] += n
    assert ranks == Counter(lengths)
    for parts in taken.values():  # gapless from 0
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(capacity - sum(n for _, n in parts) for parts in taken.values()) == one_by_one(lengths, capacity)


def test_tree_finds_the_tightest_of_all():
    r, bins, held = random.Random(3), packing.Capacities(50), Counter()
    for i in range(2000):
        n = r.randint(1, 50)
        want = min((c for c in held if c >= n and held[c]), default=None)
        assert bins.tightest(n) == want
        if want and r.random() < 0.5:
            bins.take(want)
            held[want] -= 1
        else:
            bins.put(n, i, 1)
            held[n] += 1


def test_ids_are_those_of_the_whole_text(monkeypatch):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    r = random.Random(5)
    signs = ["a", "Zü", "9", " ", "  ", "\n", "\t", "'s", "'", ".", "!?", chr(0x3000), chr(0xA0), chr(0x1C), chr(0x85), chr(0x200B), chr(0x4E2D), chr(0x1F600), "_", "<|endoftext|>", "\x00"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 60))) for _ in range(600)]
    for size in (1 << 20, 5):
        monkeypatch.setattr(packing, "SLICE", size)
        monkeypatch.setattr(packing, "KEPT", size)
        got = packing.Encoder(PATH)(texts)
        for text, ids in zip(texts, got, strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def packed(spark, rows, capacity=16):
    d = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, length int, ids string")
    return packing.pack_documents(d, PATH, capacity=capacity)


def test_every_token_has_one_place(spark):
    r = random.Random(7)
    rows = [(i, " ".join(r.choice(["one", "zwei", "trois", "x9"]) for _ in range(int(r.expovariate(0.1))))) for i in range(150)]
    rows += [(150, None), (151, ""), (None, "no id"), (None, "no id"), (7, "again"), (7, "again"), (152, "word " * 3000)]
    out = packed(spark, rows).collect()
    t = Tokenizer.from_file(PATH)
    want = Counter()
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 16 + 1
        for piece, (a, z) in enumerate(zip([0, *range(first, len(ids), 16)], [*range(first, len(ids) + 1, 16)], strict=True)):
            raw = np.array(ids[a:z], "<u4").tobytes()
            want[i, piece, a, z - a, zlib.crc32(raw), raw] += 1
    assert want == Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32, bytes(x.ids)) for x in out)
    places = {}
    for x in out:
        places.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 16
    assert len(places) == len(one_by_one([x.length for x in out], 16))


def test_sequences_hold_their_pieces(spark):
    pieces = packed(spark, [(i, "alpha beta " * (i % 5)) for i in range(20)])
    parts = {}
    for x in pieces.collect():
        parts.setdefault(x.sequence_id, []).append((x.offset, bytes(x.ids)))
    for r in packing.sequences(pieces).collect():
        of = sorted(parts.pop(r.sequence_id))
        assert bytes(r.ids) == b"".join(b for _, b in of) and r.starts == [o for o, _ in of]
    assert not parts


def test_no_documents(spark):
    assert packed(spark, []).collect() == []
