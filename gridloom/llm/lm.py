"""Interpolated modified Kneser-Ney n-gram model of order 2 or 3, counted in Spark, scored from memory-mapped sorted arrays.

A text is padded with order - 1 starts, so every token ends one n-gram of the
full order. Counts of that order are counts of occurrences, those of a lower
order are numbers of different words that precede.

Training
  1. Tasks hash their words (XXH3, 64 bits), sort and count them, and send each
     bucket (a hash range) one pair of arrays. A bucket's task merges them and
     writes sorted hashes and counts. A word's id is its rank.
  2. The same for n-grams of ids, packed. An n-gram goes to the bucket of its
     next to last word, where the statistics of its context and the preceding
     words of its last two are complete. Words frequent enough to fill a few
     buckets alone are spread by the whole n-gram instead; of these the bucket only
     sends on partial sums, which meet by context and by pair of words.
  3. Statistics of single words meet by id range. Discounts come from the
     counts of counts, a few numbers per bucket.

Buckets grow with the input in number, not in size, so one message from each part
of a task to each bucket, or from each bucket to each other, would be the square of
it. Messages go to lanes instead, runs of up to a file's buckets (one bucket each up
to ``LANES``), and a task adds up what its buckets send on before it does.

Scoring maps the files (module ``arrays``) into memory, so a worker holds only
the pages it touches, and looks up a few hundred thousand keys at a time.

The driver gets a few sums per bucket, about 100 bytes for 4 MB of text, and no
task holds more than a few buckets' worth of n-grams. Words are told apart by
64 bits of hash in counting and in lookups; n-grams exactly by ids (trigrams by
64 bits) in counting, and by 40 bits among those of a bucket in lookups, where
an unseen one passes for a seen one with a chance below one in a million.

Defined results: a null or empty text is the end token alone; a null doc_id is
hashed like an empty text; repeated rows are counted and scored each; with no
training row every token is unknown and the model is uniform over one word
(score 0); an empty table gives an empty result; other columns of the input are
left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import PER_FILE, Reader, Writer
from .blobs import bucket_count, chunks, joined, sent_packed, unpacked
from .common import scratch_path, stored

END = b"\n"  # no word holds white space
FLUSH = 1 << 20  # tokens of a task before they are sent
HELD = 1 << 18  # sums for other buckets of a task before they are sent
LANES = 256  # up to so many buckets get messages of their own
DEFAULT_DISCOUNTS = (0.5, 1.0, 1.5)
HOT = 4  # buckets' worth of tokens that a word may bring to its bucket
STATS = ("total", "n1", "n2", "n3")
#: Where a row of statistics goes: contexts of two words, pairs of words, single words as contexts, single words.
TO_CONTEXT, TO_PAIR, TO_WORD, TO_LAST = range(4)


def held_out(doc_id: Column, folds: int = 10) -> Column:
    """The fold that is not learnt from: crc32 of the id as text, modulo ``folds``, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, the end token after each text, and the number of tokens of each text."""
    flat: list[bytes] = []
    lens = np.empty(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = (text or "").encode().lower().split()
        lens[i] = len(words) + 1
        flat += words
        flat.append(END)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, flat), np.uint64, len(flat)), lens


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    z = a * np.uint64(0x9E3779B97F4A7C15) + b
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)


def gram_key(w1: np.ndarray, w2: np.ndarray, w3: np.ndarray) -> np.ndarray:
    return _mixed(pair_key(w1, w2), w3.astype(np.uint64))


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts keys, and where in it each different one starts."""
    order = np.argsort(keys)
    k = keys[order]
    return order, np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)


def _sums(start: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    return [np.add.reduceat(c.astype(np.int64), start) if len(start) else np.empty(0, np.int64) for c in columns]


def _of_counts(c: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3, 4."""
    return [int((c == k).sum()) for k in (1, 2, 3, 4)]


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts; too few counts of counts give the defaults."""
    if not (n1 and n2 and n3 and n4):
        return DEFAULT_DISCOUNTS
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(x if 0 < x <= k else e for k, (x, e) in enumerate(zip(d, DEFAULT_DISCOUNTS, strict=True), 1))


class Model:
    """Sizes and discounts; the arrays are mapped where they are used."""

    def __init__(self, root: str, buckets: int, order: int = 3, hot: float = HOT):
        self.root, self.buckets, self.order, self.hot = root, buckets, order, hot
        self.lane = 1  # buckets that a message goes to
        while self.lane < PER_FILE and self.lane * LANES < buckets:
            self.lane *= 2
        self.words: list[int] = [0] * buckets  # words of each hash range
        self.train_tokens = 0
        self.discounts = {n: DEFAULT_DISCOUNTS for n in range(1, order + 1)}
        self.cont_total, self.cont_kinds = 0, (0, 0, 0)
        self.files = Reader(root)

    @property
    def n_words(self) -> int:
        return sum(self.words)

    def range_bucket(self, h: np.ndarray) -> np.ndarray:
        """The bucket of a hash, by its range."""
        return ((h >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)

    def key_bucket(self, key: np.ndarray) -> np.ndarray:
        return self.range_bucket(_mixed(key, np.full(len(key), 7, np.uint64)))

    def id_range(self, b: int) -> tuple[int, int]:
        """Ids are dealt to buckets in equal ranges; one more than the words, for the start of a text."""
        n = self.n_words + 1
        return -(-b * n // self.buckets), -(-(b + 1) * n // self.buckets)

    def id_bucket(self, i: np.ndarray) -> np.ndarray:
        return i.astype(np.int64) * self.buckets // (self.n_words + 1)

    def lane_of(self, bucket: np.ndarray) -> np.ndarray:
        """The first bucket of the lane."""
        return bucket // self.lane * self.lane

    def frequent(self, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Words that would fill a few buckets alone, and the start of a text."""
        return (count > self.hot * self.train_tokens / self.buckets) | (ids == self.n_words)

    def find_words(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id and count of each hash; -1 and 0 if unknown."""
        unique, back = np.unique(h, return_inverse=True)
        ids, counts = np.full(len(unique), -1, np.int64), np.zeros(len(unique), np.int64)
        starts = np.concatenate([[0], np.cumsum(self.words)])
        edges = np.searchsorted(self.range_bucket(unique), np.arange(self.buckets + 1))
        for b in np.flatnonzero(np.diff(edges)).tolist():
            a, z = edges[b], edges[b + 1]
            if self.words[b]:
                known = self.files.get("words", b, "hash", np.uint64)
                at = np.minimum(np.searchsorted(known, unique[a:z]), len(known) - 1)
                hit = known[at] == unique[a:z]
                ids[a:z] = np.where(hit, starts[b] + at, -1)
                counts[a:z] = np.where(hit, self.files.get("words", b, "count", np.int64)[at], 0)
        return ids[back], counts[back]

    def _by_bucket(self, bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        # 16 bits are sorted by radix.
        yield from self._parts(bucket, np.argsort(bucket.astype(np.int16 if self.buckets < 1 << 15 else np.int32), kind="stable"))

    @staticmethod
    def _parts(bucket: np.ndarray, order: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        for part in np.split(order, cuts) if len(order) else []:
            yield int(bucket[part[0]]), part

    @staticmethod
    def _runs(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Each bucket of sorted ones, where it starts and where it ends."""
        edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else np.empty(0, np.int64)
        yield from zip(bucket[edges[:-1]].tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True)

    def look_up(self, kind: str, bucket: np.ndarray, name: str, key: np.ndarray, columns: tuple[str, ...]) -> np.ndarray:
        """Columns x keys; zeros where a key is not there."""
        out = np.zeros((len(columns), len(key)), np.int64)
        h = _mixed(key, np.full(len(key), 11, np.uint64))
        top, tail = (h >> np.uint64(32)).astype(np.uint32), (h >> np.uint64(24)).astype(np.uint8)
        # In the order of the bucket's keys, so that searches and reads go through memory once.
        order = np.argsort(bucket.astype(np.uint64) << np.uint64(32) | top)
        top, tail, found = top[order], tail[order], np.zeros((len(columns), len(key)), np.int64)
        for b, a, z in self._runs(bucket[order]):
            known = self.files.get(kind, b, f"{name}_key", np.uint32)
            if not len(known):
                continue
            tails, wanted, ends = self.files.get(kind, b, f"{name}_tail", np.uint8), top[a:z], tail[a:z]
            place = np.searchsorted(known, wanted)
            np.minimum(place, len(known) - 1, out=place)
            same = known[place] == wanted
            hit = same & (tails[place] == ends)
            open_ = np.flatnonzero(same ^ hit)
            while len(open_):  # where the first 32 bits are shared
                place[open_] += 1
                open_ = open_[place[open_] < len(known)]
                open_ = open_[known[place[open_]] == wanted[open_]]
                ends_here = tails[place[open_]] == ends[open_]
                hit[open_[ends_here]] = True
                open_ = open_[~ends_here]
            place[~hit] = 0
            for k, c in enumerate(columns):
                small = self.files.get(kind, b, f"{name}_{c}", np.uint8)[place]
                found[k, a:z] = small * hit
                if (big := (small == 255) & hit).any():
                    large = self.files.get(kind, b, f"{name}_{c}_at", np.int64)
                    found[k, a:z][big] = self.files.get(kind, b, f"{name}_{c}_large", np.int64)[np.searchsorted(large, place[big])]
        out[:, order] = found
        return out

    def by_id(self, name: str, ids: np.ndarray) -> np.ndarray:
        """A dense statistic of known ids."""
        out = np.zeros(len(ids), np.int64)
        for b, at in self._by_bucket(self.id_bucket(ids)):
            dense = self.files.get("dense", b, name, np.int64)
            if len(dense):
                out[at] = dense[ids[at] - self.id_range(b)[0]]
        return out

    def contexts(self, ids: np.ndarray, count: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, ...]:
        """Ids of the two preceding words (starts before a text), and whether the nearer one is frequent."""
        start = np.concatenate([[0], np.cumsum(lens)[:-1]])
        w2, w1, n2 = (np.concatenate([np.full(k, fill, np.int64), x[:-k]])[: len(x)] for x, k, fill in ((ids, 1, self.n_words), (ids, 2, self.n_words), (count, 1, 0)))
        w2[start] = w1[start] = self.n_words
        w1[start[lens > 1] + 1] = self.n_words
        return w1, w2, self.frequent(w2, n2)

    def _backed_off(self, n: int, p: np.ndarray, at: np.ndarray, stats: np.ndarray, count: np.ndarray) -> None:
        """One order more for tokens ``at`` with the statistics of their contexts and their own counts."""
        d = self.discounts[n]
        total, *kinds = stats
        seen = total > 0
        at, total, c = at[seen], total[seen], count[seen]
        mass = sum(x * k[seen] for x, k in zip(d, kinds, strict=True))
        p[at] = np.maximum(c - np.array((0.0, *d))[np.minimum(c, 3)], 0) / total + mass / total * p[at]

    def log10_tokens(self, h: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token: count in training, log10 of the base, log10 of the model."""
        ids, count = self.find_words(h)
        v = self.n_words
        base = np.log10((count + 0.1) / (self.train_tokens + 0.1 * (v + 1)))
        p = np.full(len(h), 1.0)
        if not v:
            return count, base, np.log10(p)
        known = ids >= 0
        d = self.discounts[1]
        p[:] = sum(x * n for x, n in zip(d, self.cont_kinds, strict=True)) / self.cont_total / (v + 1)
        c = self.by_id("last", ids[known])
        p[known] += np.maximum(c - np.array((0.0, *d))[np.minimum(c, 3)], 0) / self.cont_total
        w1, w2, hot = self.contexts(ids, count, lens)

        at = np.flatnonzero(w2 >= 0)
        unique, back = np.unique(w2[at], return_inverse=True)
        stats = np.stack([self.by_id(s, unique)[back] for s in STATS])
        pairs = np.zeros(len(h), np.int64)
        for kind, some in (("grams", known & ~hot), ("hot", known & hot)):
            x = np.flatnonzero(some & (w2 >= 0))
            key = pair_key(w2[x], ids[x])
            pairs[x] = self.look_up(kind, self.key_bucket(key) if kind == "hot" else self.id_bucket(w2[x]), "pair", key, ("n",))[0]
        self._backed_off(2, p, at, stats, pairs[at])

        if self.order == 3:
            both = (w2 >= 0) & (w1 >= 0)
            stats, grams = np.zeros((len(STATS), len(h)), np.int64), np.zeros(len(h), np.int64)
            for kind, some in (("grams", both & ~hot), ("hot", both & hot)):
                x = np.flatnonzero(some)
                key = pair_key(w1[x], w2[x])
                stats[:, x] = self.look_up(kind, self.key_bucket(key) if kind == "hot" else self.id_bucket(w2[x]), "context", key, STATS)
            x = np.flatnonzero(both & known)
            key = gram_key(w1[x], w2[x], ids[x])
            grams[x] = self.look_up("grams", np.where(hot[x], self.key_bucket(key), self.id_bucket(w2[x])), "gram", key, ("n",))[0]
            at = np.flatnonzero(both)
            self._backed_off(3, p, at, stats[:, at], grams[at])
        return count, base, np.log10(p)


# Training ------------------------------------------------------------------


def _table(name: str, keys: np.ndarray, columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Keys as sorted hashes of 40 bits (32 and 8), and their numbers: a byte each, larger ones apart."""
    h = _mixed(keys, np.full(len(keys), 11, np.uint64))
    by = np.argsort(h)
    out = {f"{name}_key": (h[by] >> np.uint64(32)).astype(np.uint32), f"{name}_tail": (h[by] >> np.uint64(24)).astype(np.uint8)}
    for c, x in columns.items():
        x = x[by]
        large = np.flatnonzero(x >= 255)
        out |= {f"{name}_{c}": np.minimum(x, 255).astype(np.uint8), f"{name}_{c}_at": large, f"{name}_{c}_large": x[large]}
    return out


def _kinds(n: np.ndarray) -> tuple[np.ndarray, ...]:
    return n, n == 1, n == 2, n >= 3


def sending_order(bucket: np.ndarray, w2: np.ndarray, w1: np.ndarray) -> np.ndarray:
    """By bucket, word and the word before it, which packs in fewer bytes than by bucket and word."""
    by = np.argsort(w2.astype(np.uint64) << np.uint64(32) | w1.astype(np.uint64))
    return by[np.argsort(bucket[by], kind="stable")]


def _in_files(df: DataFrame) -> DataFrame:
    """Buckets of one file in one task, in order."""
    return df.repartition(F.floor(F.col("bucket") / PER_FILE)).sortWithinPartitions("bucket")


def _of_lane(first: int, parts: list[list[np.ndarray]], model: Model, bucket_of) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The buckets of a lane from its messages, which are sorted by bucket."""
    if model.lane == 1:
        yield first, [np.concatenate(x) for x in zip(*parts, strict=True)]
        return
    of: dict[int, list] = {}
    for arrays in parts:
        bucket = bucket_of(*arrays)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]).tolist()
        for a, z in zip(edges, edges[1:], strict=False):
            of.setdefault(int(bucket[a]), []).append([x[a:z] for x in arrays])
    for b in sorted(of):
        yield b, [np.concatenate(x) for x in zip(*of.pop(b), strict=True)]


def _collected(batches: Iterator[pa.RecordBatch], dtypes: list, model: Model, bucket_of) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Packed rows sorted by lane -> each bucket and its arrays."""
    now, held = None, []

    def arrays():
        return _of_lane(now, [[unpacked(r[i], t, i == 0) for i, t in enumerate(dtypes)] for r in held], model, bucket_of)

    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[0] != now:
                if held:
                    yield from arrays()
                now, held = row[0], []
            held.append(row[1:])
    if held:
        yield from arrays()


OUT = "bucket int, a0 binary, a1 binary, a2 binary, a3 binary, a4 binary, dest int, of_counts array<array<long>>"


def _out(part: pa.RecordBatch | None, dest: int, bucket: int = 0, of_counts=None) -> pa.RecordBatch:
    cols = list(part.columns) if part is not None else [pa.array([bucket], pa.int32())]
    n = len(cols[0])
    cols += [pa.nulls(n, pa.binary())] * (6 - len(cols))
    return pa.RecordBatch.from_arrays([*cols, pa.array([dest] * n, pa.int32()), pa.array([of_counts] * n, pa.list_(pa.list_(pa.int64())))], names=["bucket", *[f"a{i}" for i in range(5)], "dest", "of_counts"])


class _Sums:
    """What the buckets of a task send on, added up by key; sent when there is too much of it."""

    def __init__(self, model: Model):
        self.model, self.held = model, {}

    def add(self, dest: int, key: np.ndarray, *values: np.ndarray) -> Iterator[pa.RecordBatch]:
        held = self.held.setdefault(dest, [])
        held.append((key, *values))
        if sum(len(x[0]) for x in held) > HELD:
            self._merge(held)
            if 2 * len(held[0][0]) > HELD:
                yield from self._send(dest)

    def all(self) -> Iterator[pa.RecordBatch]:
        for dest in sorted(self.held):
            self._merge(self.held[dest])
            yield from self._send(dest)

    @staticmethod
    def _merge(held: list) -> None:
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        by, start = _groups(columns[0])
        held[:] = [(columns[0][by][start], *_sums(start, *(c[by] for c in columns[1:])))]

    def _send(self, dest: int) -> Iterator[pa.RecordBatch]:
        key, *values = self.held.pop(dest)[0]
        bucket = self.model.id_bucket(key) if dest in (TO_WORD, TO_LAST) else self.model.key_bucket(key)
        by = np.argsort(bucket, kind="stable")
        for part in joined(sent_packed(self.model.lane_of(bucket[by]), key[by], *[v[by].astype(np.uint64) for v in values])):
            yield _out(part, dest)


def train(texts: DataFrame, buckets: int | None = None, order: int = 3, hot: float = HOT) -> Model:
    """``text`` -> a model in the shared folder."""
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    buckets = buckets or bucket_count(texts)
    model = Model(scratch_path(texts.sparkSession, "lm"), buckets, order, hot)

    def in_parts(batches, prepare, flush):
        held, n = [], 0

        def columns():
            out = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            return out

        for _, part in chunks(batches, 0):
            held.append(prepare(*tokens(part)))
            n += len(held[-1][0])
            if n > FLUSH:
                yield from flush(columns())
                n = 0
        if held:
            yield from flush(columns())

    def count_words(batches):
        def flush(cols):
            keys, counts = np.unique(cols[0], return_counts=True)
            yield from joined(sent_packed(model.lane_of(model.range_bucket(keys)), keys, counts.astype(np.uint32)))

        yield from in_parts(batches, lambda h, _: (h,), flush)

    def merge_words(batches):
        rows, files = [], Writer(model.root, "words")
        for b, (keys, counts) in _collected(batches, [np.uint64, np.uint32], model, lambda keys, _: model.range_bucket(keys)):
            by, start = _groups(keys)
            (counts,) = _sums(start, counts[by])
            files.put(b, {"hash": keys[by][start], "count": counts})
            rows.append((b, len(start), int(counts.sum())))
        files.close()
        cols = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["bucket", "n", "total"])

    sent = texts.select("text").mapInArrow(count_words, "bucket int, a0 binary, a1 binary")
    for r in _in_files(sent).mapInArrow(merge_words, "bucket long, n long, total long").collect():
        model.words[r["bucket"]] = r["n"]
        model.train_tokens += r["total"]
    if not model.train_tokens:
        return model
    if model.n_words >= (1 << 32) - 1:
        raise ValueError("more than 2^32 words")

    def keys_of(w1, w2, w3):
        return gram_key(w1, w2, w3) if order == 3 else pair_key(w2, w3)

    def gram_bucket(key, w2, hot):
        return np.where(hot == 1, model.key_bucket(key), model.id_bucket(w2))

    def count_grams(batches):
        def prepare(h, lens):
            ids, count = model.find_words(h)
            w1, w2, hot = model.contexts(ids, count, lens)
            w1, w2, w3 = (x.astype(np.uint32) for x in (w1, w2, ids))
            return keys_of(w1, w2, w3), w1, w2, w3, hot.astype(np.uint8)

        def flush(cols):
            by, start = _groups(cols[0])
            counts, first = np.diff(np.append(start, len(by))), by[start]
            key, w1, w2, w3, hot = (x[first] for x in cols)
            bucket = gram_bucket(key, w2, hot)
            by = sending_order(bucket, w2, w1)
            yield from joined(sent_packed(model.lane_of(bucket[by]), w2[by], w1[by], w3[by], counts[by].astype(np.uint32), hot[by]))

        yield from in_parts(batches, prepare, flush)

    def numbers(sums, pair, n):
        """What is known of single words from counts of different pairs."""
        by, start = _groups(pair >> np.uint64(32))
        first = (pair[by][start] >> np.uint64(32)).astype(np.uint32)
        yield from sums.add(TO_WORD, first, *_sums(start, *(k[by] for k in _kinds(n))))
        last, c = np.unique((pair & np.uint64(0xFFFFFFFF)).astype(np.uint32), return_counts=True)
        yield from sums.add(TO_LAST, last, c)

    def merge_grams(batches):
        files, sums = Writer(model.root, "grams"), _Sums(model)
        for b, (w2, w1, w3, count, hot) in _collected(batches, [np.uint32] * 4 + [np.uint8], model, lambda w2, w1, w3, _, hot: gram_bucket(keys_of(w1, w2, w3), w2, hot)):
            key = keys_of(w1, w2, w3)
            by, start = _groups(key)
            (n,) = _sums(start, count[by])
            key, w1, w2, w3, hot = (x[by][start] for x in (key, w1, w2, w3, hot))
            arrays, of = {}, [_of_counts(n), [0] * 4]
            for spread in (False, True):
                at = np.flatnonzero(hot == spread)
                pair = pair_key(w2[at], w3[at])
                p_by, p_start = _groups(pair)
                pairs = pair[p_by][p_start]
                preceding = _sums(p_start, np.ones(len(at)) if order == 3 else n[at][p_by])[0]
                if order == 3:
                    context = pair_key(w1[at], w2[at])
                    c_by, c_start = _groups(context)
                    stats = _sums(c_start, *(k[c_by] for k in _kinds(n[at])))
                    if spread:
                        yield from sums.add(TO_CONTEXT, context[c_by][c_start], *stats)
                    else:
                        arrays |= _table("context", context[c_by][c_start], dict(zip(STATS, stats, strict=True)))
                if spread:
                    yield from sums.add(TO_PAIR, pairs, preceding)
                else:
                    arrays |= _table("pair", pairs, {"n": preceding})
                    of[1] = _of_counts(preceding)
                    yield from numbers(sums, pairs, preceding)
            if order == 3:
                arrays |= _table("gram", key, {"n": n})
            files.put(b, arrays)
            yield _out(None, -1, b, of if order == 3 else [of[1]])
        files.close()
        yield from sums.all()

    def merge_hot(batches):
        """What frequent words sent on: a bucket's contexts and pairs."""
        files, sums, now, held = Writer(model.root, "hot"), _Sums(model), None, {}

        def close():
            of: dict[int, dict] = {}
            for dest in sorted(held):
                for b, columns in _of_lane(now, held[dest], model, lambda key, *_: model.key_bucket(key)):
                    by, start = _groups(columns[0])
                    keys, values = columns[0][by][start], _sums(start, *(c[by] for c in columns[1:]))
                    if dest == TO_CONTEXT:
                        of[b] = _table("context", keys, dict(zip(STATS, values, strict=True)))
                    else:
                        of[b] = of.get(b, {}) | _table("pair", keys, {"n": values[0]})
                        yield from numbers(sums, keys, values[0])
                        yield _out(None, -1, b, [[0] * 4, _of_counts(values[0])] if order == 3 else [_of_counts(values[0])])
            for b in sorted(of):
                files.put(b, of[b])

        for batch in batches:
            for b, *values, dest in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if b != now:
                    if held:
                        yield from close()
                    now, held = b, {}
                held.setdefault(dest, []).append([unpacked(v, np.uint64, i == 0) for i, v in enumerate(values) if v is not None])
        if held:
            yield from close()
        files.close()
        yield from sums.all()

    sent = texts.select("text").mapInArrow(count_grams, "bucket int, a0 binary, a1 binary, a2 binary, a3 binary, a4 binary")
    counted = stored(_in_files(sent).mapInArrow(merge_grams, OUT), "gram_counts")
    spread = counted.filter(F.col("dest").isin(TO_CONTEXT, TO_PAIR)).drop("of_counts")
    counted = counted.union(stored(_in_files(spread).mapInArrow(merge_hot, OUT), "hot_counts"))
    sums = {n: [0] * 4 for n in range(2, order + 1)}
    for r in counted.filter("dest = -1").select("of_counts").collect():
        for n, of in zip(range(order, 1, -1), r["of_counts"], strict=True):
            sums[n] = [s + x for s, x in zip(sums[n], of, strict=True)]
    model.discounts |= {n: discounts(*x) for n, x in sums.items()}

    def merge_words_of(batches):
        """Dense statistics of id ranges."""
        rows, files, now, dense, lo = [], Writer(model.root, "dense"), None, None, 0

        def close():
            for b in range(now, min(now + model.lane, model.buckets)):
                a, z = (x - lo for x in model.id_range(b))
                files.put(b, {n: x[a:z] for n, x in dense.items()})
            last = dense["last"]
            rows.append((int(last.sum()), int((last >= 3).sum()), *_of_counts(last)))

        for batch in batches:
            for b, *values, dest in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if b != now:
                    if dense is not None:
                        close()
                    lo, hi = model.id_range(b)[0], model.id_range(min(b + model.lane, model.buckets) - 1)[1]
                    now, dense = b, {n: np.zeros(hi - lo, np.int64) for n in (*STATS, "last")}
                at = unpacked(values[0], np.uint32, True).astype(np.int64) - lo
                for name, v in zip(STATS if dest == TO_WORD else ("last",), values[1:], strict=False):
                    dense[name][at] += unpacked(v, np.uint64).astype(np.int64)  # ids of one part are distinct
        if dense is not None:
            close()
        files.close()
        cols = list(zip(*rows, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["sum", "n3p", "n1", "n2", "n3", "n4"])

    parts = counted.filter(F.col("dest").isin(TO_WORD, TO_LAST)).drop("of_counts")
    of, kinds = [0] * 4, [0] * 3
    for r in _in_files(parts).mapInArrow(merge_words_of, "sum long, n3p long, n1 long, n2 long, n3 long, n4 long").collect():
        model.cont_total += r["sum"]
        of = [s + r[f"n{i + 1}"] for i, s in enumerate(of)]
        kinds = [kinds[0] + r["n1"], kinds[1] + r["n2"], kinds[2] + r["n3p"]]
    model.discounts[1], model.cont_kinds = discounts(*of), tuple(kinds)
    return model


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, held_out) scored: base and model log10 probabilities of whole texts."""
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches):
        for part, texts in chunks(batches, 2):
            h, lens = tokens(texts)
            count, base, lp = model.log10_tokens(h, lens)
            at = np.concatenate([[0], np.cumsum(lens)[:-1]])
            cols = [part.column(0), part.column(1), pa.array(lens), pa.array(np.add.reduceat((count > 0).astype(np.int64), at)), pa.array(np.full(len(lens), model.train_tokens))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(lp, at))], names=names)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return docs.select("doc_id", "held_out", "text").mapInArrow(run, schema)


def kneser_ney_scores(docs: DataFrame, *, order: int = 3, folds: int = 10, buckets: int | None = None, hot: float = HOT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id"), folds).alias("held_out"))
    model = train(d.filter(~F.col("held_out")), buckets, order, hot)
    return score_texts(d, model)
