"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A token is a word: a hashed word embedding beside the mean of its hashed
character-trigram embeddings, so unseen forms of a known stem still count. The
network reads windows of ``WINDOW`` words that overlap by ``WINDOW - STRIDE``;
every window of every text is scored and a document is as toxic as its worst
window.

Training uses at most ``per_class`` labelled documents of each class (chosen by
a hash of the id), whole, one text for an id; that bound is the whole of what
the driver collects. Documents carry the label, not windows, so after a third
of the steps over random windows each document is represented by its currently
worst window. The number of steps is a parameter and does not depend on the
sample. Scores are calibrated on document level at the labels' own base rate.

Scoring is row-wise over all texts: no shuffle; the weights (under 1 MB,
whatever the corpus) are broadcast. A long text is scored in pieces that
overlap like its windows, so memory does not grow with its length.

Defined results: null and empty texts are one empty window and get its score; a
null doc_id is hashed like an empty text; repeated rows are kept; null labels
are not learnt from; an id with several labels counts as toxic if one says so,
and one with several texts is learnt from its smallest; without a label of
either class every score is the share of positive labels (0 without labels); an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import chunks

WINDOW, STRIDE = 32, 24
WORDS, GRAMS, WORD_DIM, GRAM_DIM, HIDDEN = 8192, 8192, 8, 8, 8
PART = 384 << 10  # bytes of text scored at a time
PIECE = 2048  # windows of one text at a time
f4 = np.float32


@dataclass
class Tokens:
    """Words of texts laid end to end."""

    word: np.ndarray  # hashed word of each token
    gram: np.ndarray  # hashed trigram of each character
    start: np.ndarray  # first character of each token
    size: np.ndarray  # characters of each token
    lens: np.ndarray  # tokens of each text


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def pieces(words: list[bytes]) -> Iterator[list[bytes]]:
    """The words of ``PIECE`` windows at a time; together they have the windows of the whole."""
    step = PIECE * STRIDE
    for at in range(0, max(1, len(words) - (WINDOW - STRIDE)), step):
        yield words[at : at + step + WINDOW - STRIDE]


def tokenise(texts: list[str | None], step: int = 64) -> Tokens:
    """Tokens of texts, ``step`` texts at a time: words held as objects take many times their bytes."""
    parts = [tokens_of([split_words(t) for t in texts[at : at + step]]) for at in range(0, max(1, len(texts)), step)]
    word, gram, size, lens = (np.concatenate([getattr(p, k) for p in parts]) for k in ("word", "gram", "size", "lens"))
    return Tokens(word, gram, np.cumsum(size) - size, size, lens)


def tokens_of(texts: list[list[bytes]]) -> Tokens:
    words = [w for t in texts for w in t]
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    size = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    mixed = data[:-2] * np.uint32(0x9E3779B1) ^ data[1:-1] * np.uint32(0x85EBCA6B) ^ data[2:] * np.uint32(0xC2B2AE35)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    mixed ^= mixed >> np.uint32(13)
    inner = np.flatnonzero(data[1:-1] != 32)  # a word's own characters
    gram = mixed[inner]
    at = np.cumsum(size) - size
    # A word's number mixes its trigrams with their order.
    salted = gram * ((np.arange(len(gram)) - np.repeat(at, size)).astype(np.uint32) * np.uint32(2654435761) | np.uint32(1))
    word = np.add.reduceat(salted, at) if len(words) else np.empty(0, np.uint32)
    word = (word ^ (word >> np.uint32(16))) * np.uint32(0x7FEB352D)
    return Tokens(((word >> np.uint32(10)) % WORDS).astype(np.uint16), (gram % GRAMS).astype(np.uint16), at, size, lens)


def some_tokens(t: Tokens, at: np.ndarray) -> Tokens:
    """Tokens ``at`` as one text."""
    size = t.size[at]
    start = np.cumsum(size) - size
    chars = np.repeat(t.start[at] - start, size) + np.arange(int(size.sum()))
    return Tokens(t.word[at], t.gram[chars], start, size, np.array([len(at)]))


def window_index(lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers of every window (-1: beyond the text) and the text of each window."""
    n = np.maximum(1, -(-(lens - (WINDOW - STRIDE)) // STRIDE))
    text = np.repeat(np.arange(len(lens)), n)
    inner = (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
    pos = inner[:, None] + np.arange(WINDOW)
    first = np.cumsum(lens) - lens
    return np.where(pos < lens[text][:, None], first[text][:, None] + pos, -1), text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return f4(0.5) * np.tanh(f4(0.5) * x) + f4(0.5)


class Network:
    """Two GRUs, linear attention over their joint states, one logit a window."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        d, h = WORD_DIM + GRAM_DIM, HIDDEN
        make = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(f4)
        self.p = {
            "word": (rng.standard_normal((WORDS, WORD_DIM)) * 0.1).astype(f4),
            "gram": (rng.standard_normal((GRAMS, GRAM_DIM)) * 0.3).astype(f4),
            **{f"W{k}": make(d, 3 * h) for k in "fb"},
            **{f"U{k}": make(h, 3 * h) for k in "fb"},
            **{f"c{k}": np.zeros(3 * h, f4) for k in "fb"},
            "att": make(2 * h),
            "out": make(2 * h),
            "bias": np.zeros(1, f4),
        }
        self.scale, self.shift = 1.0, 0.0

    def vectors(self, t: Tokens, keep: np.ndarray | None = None) -> np.ndarray:
        if not len(t.size):
            return np.zeros((0, WORD_DIM + GRAM_DIM), f4)
        grams = np.add.reduceat(self.p["gram"][t.gram], t.start, axis=0) / t.size[:, None].astype(f4)
        words = self.p["word"][t.word]
        return np.concatenate([words if keep is None else words * keep, grams], axis=1)

    def _run(self, x: np.ndarray, mask: np.ndarray, k: str, tape: list | None) -> np.ndarray:
        """States of one direction; x: time x windows x 3 hidden, already in reading order."""
        h, states = np.zeros((x.shape[1], HIDDEN), f4), np.empty((x.shape[0], x.shape[1], HIDDEN), f4)
        u, n = self.p[f"U{k}"], HIDDEN
        for s in range(x.shape[0]):
            a = h @ u
            zr = _sigmoid(x[s, :, : 2 * n] + a[:, : 2 * n])
            z, r = zr[:, :n], zr[:, n:]
            c = np.tanh(x[s, :, 2 * n :] + r * a[:, 2 * n :])
            new = c + z * (h - c)
            m = mask[s][:, None]
            if tape is not None:
                tape.append((h, z, r, c, a[:, 2 * n :], m))
            h = np.where(m, new, h)
            states[s] = h
        return states

    def logits(self, vec: np.ndarray, index: np.ndarray, tape: dict | None = None) -> np.ndarray:
        idx = index.T
        mask = idx >= 0
        safe = np.maximum(idx, 0)
        if not len(vec):
            vec = np.zeros((1, WORD_DIM + GRAM_DIM), f4)
        states = []
        tapes = {"f": [] if tape is not None else None, "b": [] if tape is not None else None}
        for k, order in (("f", slice(None)), ("b", slice(None, None, -1))):
            proj = vec @ self.p[f"W{k}"] + self.p[f"c{k}"]
            states.append(self._run(proj[safe[order]], mask[order], k, tapes[k])[order])
        h = np.concatenate(states, axis=2)
        e = np.where(mask, h @ self.p["att"], f4(-1e9))
        e = np.exp(e - e.max(axis=0))
        a = np.where(mask, e, 0) / np.maximum(e.sum(axis=0), f4(1e-9))
        pooled = np.einsum("tn,tnh->nh", a, h)
        if tape is not None:
            tape.update(h=h, a=a, pooled=pooled, mask=mask, safe=safe, tapes=tapes, vec=vec)
        return pooled @ self.p["out"] + self.p["bias"][0]

    def gradients(self, tape: dict, d_logit: np.ndarray, t: Tokens, keep: np.ndarray | None) -> dict[str, np.ndarray]:
        p, n = self.p, HIDDEN
        h, a, mask, safe, vec = (tape[k] for k in ("h", "a", "mask", "safe", "vec"))
        g = {"out": tape["pooled"].T @ d_logit, "bias": np.array([d_logit.sum()], f4)}
        d_pooled = d_logit[:, None] * p["out"]
        da = np.einsum("nh,tnh->tn", d_pooled, h)
        de = a * (da - (a * da).sum(axis=0))
        dh_all = a[:, :, None] * d_pooled[None] + de[:, :, None] * p["att"]
        g["att"] = np.einsum("tn,tnh->h", de, h)
        d_vec = np.zeros_like(vec)
        for k, order, part in (("f", slice(None), slice(0, n)), ("b", slice(None, None, -1), slice(n, 2 * n))):
            dhs = dh_all[order][:, :, part]
            dx = np.zeros((*dhs.shape[:2], 3 * n), f4)
            du = np.zeros_like(p[f"U{k}"])
            carry = np.zeros(dhs.shape[1:], f4)
            for s in range(len(dhs) - 1, -1, -1):
                prev, z, r, c, ac, m = tape["tapes"][k][s]
                dh = carry + dhs[s]
                dn = np.where(m, dh, 0)
                dz = dn * (prev - c) * z * (1 - z)
                dc = dn * (1 - z) * (1 - c * c)
                dr = dc * ac * r * (1 - r)
                d_a = np.concatenate([dz, dr, dc * r], axis=1)
                dx[s] = np.concatenate([dz, dr, dc], axis=1)
                du += prev.T @ d_a
                carry = np.where(m, dn * z, dh) + d_a @ p[f"U{k}"].T
            dx = dx[order]
            flat, rows = dx[mask], safe[mask]
            g[f"U{k}"], g[f"c{k}"] = du, flat.sum(axis=0)
            g[f"W{k}"] = vec[rows].T @ flat
            np.add.at(d_vec, rows, flat @ p[f"W{k}"].T)
        d_vec = d_vec[: len(t.size)]
        d_word = d_vec[:, :WORD_DIM] if keep is None else d_vec[:, :WORD_DIM] * keep
        g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
        np.add.at(g["word"], t.word, d_word)
        np.add.at(g["gram"], t.gram, np.repeat(d_vec[:, WORD_DIM:] / np.maximum(t.size, 1)[:, None].astype(f4), t.size, axis=0))
        return g

    def window_logits(self, t: Tokens, index: np.ndarray, step: int = 4096) -> np.ndarray:
        """Logits of windows in the order of their tokens; each part looks at its own tokens only."""
        out = []
        for at in range(0, len(index), step):
            part = index[at : at + step]
            used = part[part >= 0]
            lo, hi = (int(used.min()), int(used.max()) + 1) if len(used) else (0, 0)
            out.append(self.logits(self.vectors(some_tokens(t, np.arange(lo, hi))), np.where(part >= 0, part - lo, -1)))
        return np.concatenate(out)

    def score(self, texts: list[str | None]) -> np.ndarray:
        worst = np.full(len(texts), -np.inf)
        held: list[list[bytes]] = []
        owner: list[int] = []

        def flush() -> None:
            t = tokens_of(held)
            index, text = window_index(t.lens)
            np.maximum.at(worst, np.array(owner)[text], self.window_logits(t, index))
            held.clear()
            owner.clear()

        words = 0
        for i, text in enumerate(texts):
            for piece in pieces(split_words(text)):
                held.append(piece)
                owner.append(i)
                words += len(piece)
                if words > PIECE * STRIDE:
                    flush()
                    words = 0
        if held:
            flush()
        return 1 / (1 + np.exp(-(self.scale * worst + self.shift)))


def train(examples: list[tuple[str, int]], prior: float, *, steps: int = 384, refresh: int = 32, rate: float = 0.02, batch: int = 128, seed: int = 7) -> Network:
    """``examples``: texts and labels; the list is emptied. ``prior``: the share of positive labels. Worst windows are looked up anew every ``refresh`` steps."""
    net, rng = Network(seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    label = np.array([y for _, y in examples], f4)
    t = tokenise([x for x, _ in examples])
    examples.clear()  # the texts are not needed any more
    index, text = window_index(t.lens)
    index = index.astype(np.int32)
    first = np.flatnonzero(np.diff(text, prepend=-1))
    count = np.diff(np.concatenate([first, [len(text)]]))
    queue = np.empty(0, np.int64)
    for step in range(1, steps + 1):
        late = 3 * step > steps
        if late and (step % refresh == 0 or 3 * (step - 1) <= steps):
            lg = net.window_logits(t, index)
            peak = np.maximum.reduceat(lg, first)
            hit = np.flatnonzero(lg == peak[text])
            worst = hit[np.searchsorted(text[hit], np.arange(len(label)))]
        while len(queue) < batch:  # every document before any again
            queue = np.concatenate([queue, rng.permutation(len(label))])
        at, queue = queue[:batch], queue[batch:]
        chosen = first[at] + (rng.random(batch) * count[at]).astype(np.int64)
        if late:
            other = (rng.random(batch) < 0.3) & (label[at] == 0)  # clean documents also show other windows
            chosen = np.where(other, chosen, worst[at])
        rows = index[chosen]
        part = some_tokens(t, rows[rows >= 0])
        local = np.where(rows >= 0, np.cumsum(rows >= 0).reshape(rows.shape) - 1, -1)
        keep = (rng.random((len(part.size), 1)) < 0.5).astype(f4)  # so that characters must do
        tape: dict = {}
        lg = net.logits(net.vectors(part, keep), local, tape)
        g = net.gradients(tape, ((1 / (1 + np.exp(-lg)) - label[at]) / batch).astype(f4), part, keep)
        lr = rate * (1 - 0.9 * step / steps) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        for key, x in g.items():
            x = x + f4(1e-5) * net.p[key]
            m[key] += f4(0.1) * (x - m[key])
            v[key] += f4(0.001) * (x * x - v[key])
            net.p[key] -= f4(lr) * m[key] / (np.sqrt(v[key]) + f4(1e-7))
    peak = np.maximum.reduceat(net.window_logits(t, index), first).astype(np.float64)
    net.scale, net.shift = _calibrated(peak, label, prior)
    return net


def _calibrated(x: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Logistic fit of label on the worst window's logit, classes weighted to the base rate; a light ridge keeps it finite."""
    w = np.where(y == 1, prior / y.sum(), (1 - prior) / (1 - y).sum()) * len(y)
    a, b = 1.0, 0.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(w * (q - y) * x).sum() + 0.1 * (a - 1), (w * (q - y)).sum() + 0.01 * b])
        s = w * q * (1 - q) + 1e-6
        hess = np.array([[(s * x * x).sum() + 0.1, (s * x).sum()], [(s * x).sum(), s.sum() + 0.01]])
        d = np.linalg.solve(hess, g)
        a, b = a - float(np.clip(d[0], -1, 1)), b - float(np.clip(d[1], -5, 5))
    return max(a, 1e-3), b


def held_out(doc_id):
    """The fold that labels are not learnt from: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, *, per_class: int = 1024, **training) -> Network | float:
    """A network, or the share of positive labels where a class has no example."""
    known = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").alias("l_id")).agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    total = known.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    prior = (total[1] or 0) / total[0] if total[0] else 0.0
    order = (F.xxhash64("l_id"), F.col("l_id"))
    chosen = known.filter("toxic = 1").orderBy(*order).limit(per_class).union(known.filter("toxic = 0").orderBy(*order).limit(per_class))
    # At most 2 * per_class rows, and as many texts: a proven bound for the broadcast and for the driver.
    texts = docs.select(F.col("doc_id").alias("d_id"), "text")
    picked = texts.join(F.broadcast(chosen), F.col("d_id") == F.col("l_id")).groupBy("l_id", "toxic").agg(F.min("text").alias("text"))
    examples = sorted((r["text"] or "", r["toxic"]) for r in picked.select("text", "toxic").collect())
    if not 0 < sum(y for _, y in examples) < len(examples):
        return prior
    return train(examples, prior, **training)


def score_toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, keep: bool = False, training: DataFrame | None = None, **options) -> DataFrame:
    """doc_id, held_out, score, predicted; with ``keep`` all columns of ``docs`` plus score and predicted.

    ``training``: the documents that labels refer to, where they are not ``docs`` themselves.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(training if training is not None else docs, labels, **options))
    rest = [c for c in docs.columns if c not in ("score", "predicted", "text")] if keep else ["doc_id", "held_out"]
    given = docs.select(*rest, F.col("text")) if keep else docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text"))

    names = [*rest, "text"] if keep else rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for part, texts in chunks(batches, len(rest), PART):
            s = net.score(texts) if isinstance(net, Network) else np.full(len(texts), float(net))
            yield pa.RecordBatch.from_arrays([*(part.columns if keep else part.columns[:-1]), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    kinds = {f.name: f.dataType.simpleString() for f in given.schema.fields}
    return given.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", score double, predicted int")
