"""Exact removal of repeated strings of ``width`` bytes, one suffix bucket at a time.

The suffixes that can matter are the ``width``-byte windows. They are dealt to
buckets through a cover sample: of a window's ``width - gram + 1`` grams the one
with the smallest hash (ties: leftmost) is its anchor. Equal windows have the
same anchor at the same offset, which is what a difference cover guarantees for
positions; the content-defined cover samples 2.6 % of positions where a
positional cover of this width needs 12-14 %, all of which would be shuffled.

1. Runs. Consecutive windows with the same anchor are one run. A run is sent
   to its anchor's bucket with the rank of its whole string (a hash of the run's
   bytes and the anchor's offset in it). Bucket by bucket, runs are sorted by
   (anchor, rank, place): a run whose string occurs earlier is removed whole, by
   rank alone, however long the tie; an anchor of one run needs nothing more.
   Tasks combine before they send: of the runs of one string that a task holds,
   only the earliest goes to the anchor's bucket, and the others, which are
   copies whatever other tasks hold, go to their documents' buckets.
2. Only where one anchor has several different strings, the first run of each
   string sends its bytes. Within the bucket their windows are sorted by
   (anchor, hash of the window, place), and all but the first of each go. That
   is done for ``PIECE`` bytes at a time: whole anchors, and for an anchor of
   more bytes one range of window hashes after another.
3. Removed runs go back to their documents.

A copy of a passage costs one small row per 38 bytes and its bytes only where
its surroundings change, so groups of thousands of copies stay linear. Buckets
are hash ranges of anchors, and memory is bounded by a bucket.

Equality is by 64-bit hashes of the anchor and of the window together.

Defined results: a null text is empty and keeps nothing; texts shorter than
``width`` stay; a null doc_id takes no part and stays whole; rows that repeat a
doc_id are copies of one document, whose removed places are united; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import bucket_count, chunks, gathered, per_bucket, sent
from .common import stored

TEXT = 768 << 10  # bytes of text hashed at a time
RUNS = 300_000  # runs of a task before they are sent
PIECE = 1 << 20  # bytes of runs whose windows are sorted at a time
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BYTES = np.array([xxhash.xxh3_64_intdigest(bytes([b])) for b in range(256)], np.uint64)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * A + b
    x ^= x >> np.uint64(29)
    x *= B
    x ^= x >> np.uint64(32)
    return x


def string_hashes(data: np.ndarray, lengths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Hashes of all substrings of each length: doubled up to the power of two below, then two that overlap."""
    out, h, n = {}, _BYTES[data], 1
    top = max(lengths)
    while True:
        for k in lengths:
            if n <= k < 2 * n:
                out[k] = h if k == n else (_mix(h[: len(h) - (k - n)], h[k - n :]) if len(h) > k - n else h[:0])
        if 2 * n > top:
            return out
        h = _mix(h[:-n], h[n:]) if len(h) > n else h[:0]
        n *= 2


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = 1
    while 2 * n <= w:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - (w - n)], x[w - n :]) if w > n else x


def runs(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of texts laid end to end: anchor hash, rank, text number, start in the text, windows, anchor offset."""
    none = tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64))
    if len(data) < width:
        return none
    half = 1 << (width.bit_length() - 1)  # 64 of 100: two cover a window, three a run
    h = string_hashes(data, (gram, half))
    grams, halves = h[gram], h[half]
    span = width - gram + 1
    packed = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    anchor = (_sliding_min(packed, span) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(lens)), lens)[: len(anchor)]
    valid = np.arange(len(anchor)) + width <= (starts + lens)[text]
    at = np.flatnonzero(valid)
    if not len(at):
        return none
    anchor, text = anchor[at], text[at]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(text) != 0)]))
    first, n = at[new], np.diff(np.concatenate([new, [len(at)]]))
    anchor, text = anchor[new], text[new]
    size = n - 1 + width
    rank = _mix(_mix(halves[first], halves[first + (size - half) // 2]), halves[first + size - half])
    rank = _mix(rank, ((anchor - first) * 1024 + n).astype(np.uint64))
    return grams[anchor], rank, text, first - starts[text], n, anchor - first


def _laid(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = [(t or "").encode() for t in texts]
    lens = np.fromiter(map(len, raw), np.int64, len(raw))
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum(lens) - lens, lens


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _doc_bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    return _bucket(_mix(doc.astype(np.int64).view(np.uint64), np.full(len(doc), A)), buckets)


def _by_bucket(bucket: np.ndarray, *arrays: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.argsort(bucket, kind="stable")
    yield from sent(bucket[order], *[x[order] for x in arrays])


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """True where any of the sorted keys changes."""
    out = np.zeros(len(keys[0]), bool)
    out[:1] = True
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


def _copies(anchor: np.ndarray, rank: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Of runs sorted by (anchor, rank, place): those whose string has an earlier place."""
    of_string = _firsts(anchor, rank)
    first = np.flatnonzero(of_string)[np.cumsum(of_string) - 1]
    return (doc != doc[first]) | (start != start[first])


def repeated_runs(docs: DataFrame, width: int, gram: int, buckets: int) -> DataFrame:
    """bucket (of documents), a0 doc, a1 start, a2 windows, a3 anchor (0: remove the run), a4 anchor offset."""

    def send(batches):
        held, rows = [], 0

        def flush():
            anchor, rank, doc, start, *rest = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((start, doc, rank, anchor))
            copy = np.zeros(len(anchor), bool)
            copy[order] = _copies(anchor[order], rank[order], doc[order], start[order])
            bucket = np.where(copy, _doc_bucket(doc, buckets), _bucket(anchor, buckets))
            anchor = np.where(copy, np.uint64(0), np.maximum(anchor, np.uint64(1)))
            yield from _by_bucket(bucket, anchor, rank, doc, start, *rest)

        for part, texts in chunks(batches, 1, TEXT):
            anchor, rank, text, start, n, off = runs(*_laid(texts), width, gram)
            doc = part.column(0).to_numpy()[text]
            held.append((anchor, rank, doc, start.astype(np.uint32), n.astype(np.uint8), off.astype(np.uint8)))
            rows += len(anchor)
            if rows > RUNS:
                yield from flush()
                held, rows = [], 0
        if rows:
            yield from flush()

    def sort(batches):
        types = [np.uint64, np.uint64, np.int64, np.uint32, np.uint8, np.uint8]
        for _, (anchor, rank, doc, start, n, off) in gathered(batches, types):
            order = np.lexsort((start, doc, rank, anchor))
            anchor, rank, doc, start, n, off = (x[order] for x in (anchor, rank, doc, start, n, off))
            of_string = _firsts(anchor, rank)
            copy = (anchor == 0) | _copies(anchor, rank, doc, start)
            group = np.cumsum(_firsts(anchor)) - 1
            strings = np.bincount(group[of_string])[group]
            keep = np.flatnonzero(copy | (of_string & (strings > 1)))
            a = np.where(copy, np.uint64(0), anchor)[keep]
            yield from _by_bucket(_doc_bucket(doc[keep], buckets), doc[keep], start[keep], n[keep], a, off[keep])

    rows = docs.mapInArrow(send, "bucket int, a0 binary, a1 binary, a2 binary, a3 binary, a4 binary, a5 binary")
    return per_bucket(rows, sort, "bucket int, a0 binary, a1 binary, a2 binary, a3 binary, a4 binary")


RUN_TYPES = [np.int64, np.uint32, np.uint8, np.uint64, np.uint8]


def _with_texts(docs: DataFrame, found: DataFrame, buckets: int, keep: list[str]) -> DataFrame:
    """Rows by document bucket: first the bucket's runs (kind 0), then its documents (kind 1)."""

    def number(batches):
        for b in batches:
            doc = b.column(0)
            ids = doc.fill_null(0).to_numpy(zero_copy_only=False)
            ids = np.where(doc.is_null().to_numpy(zero_copy_only=False), np.arange(len(ids)), ids)  # these may lie anywhere
            yield pa.RecordBatch.from_arrays([pa.array(_doc_bucket(ids, buckets).astype(np.int32)), *b.columns], names=["bucket", *b.schema.names])

    texts = docs.select("doc_id", "text").mapInArrow(number, "bucket int, doc_id long, text string")
    texts = texts.selectExpr("bucket", "1 kind", "doc_id", "text", *[f"cast(null as binary) {c}" for c in keep])
    found = found.selectExpr("bucket", "0 kind", "cast(null as long) doc_id", "cast(null as string) text", *keep)
    return found.union(texts).repartition("bucket").sortWithinPartitions("bucket", "kind")


def _met(batches: Iterator[pa.RecordBatch], types: list) -> Iterator[tuple[list[np.ndarray], pa.RecordBatch]]:
    """The runs of a bucket, sorted by document, with each batch of its documents."""
    none = [np.empty(0, t) for t in types]
    now, held, arrays = None, [], None
    for batch in batches:
        bucket = batch.column(0).to_numpy()
        for part in np.split(np.arange(len(bucket)), np.flatnonzero(np.diff(bucket)) + 1):
            if not len(part):
                continue
            if bucket[part[0]] != now:
                now, held, arrays = bucket[part[0]], [], None
            b = batch.slice(part[0], len(part))
            kind = b.column(1).to_numpy()
            k = int((kind == 0).sum())
            held += list(zip(*[b.column(i).slice(0, k).to_pylist() for i in range(4, 4 + len(types))], strict=True))
            if k == len(part):
                continue
            if arrays is None:
                arrays = [np.frombuffer(b"".join(x), t) for x, t in zip(zip(*held, strict=True), types, strict=True)] if held else none
                order = np.argsort(arrays[0], kind="stable")
                arrays, held = [x[order] for x in arrays], []
            for texts, _ in chunks([b.slice(k)], 3, TEXT):
                yield arrays, texts


def repeated_windows(anchor: np.ndarray, doc: np.ndarray, start: np.ndarray, n: np.ndarray, base: np.ndarray, data: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """doc, place of the windows of runs that also start earlier; a run's bytes lie at ``base`` of ``data``."""
    sizes = n - 1 + width
    ranges = -(-int(sizes.sum()) // (2 * PIECE))  # one, unless a single anchor has more
    cut = np.flatnonzero(np.diff(np.cumsum(sizes) // PIECE)) + 1
    for k in range(ranges):
        held = []
        for at in np.split(np.arange(len(n)), cut):
            size = sizes[at]
            own = np.cumsum(size) - size
            bytes_ = data[np.repeat(base[at] - own, size) + np.arange(int(size.sum()))]
            which = np.repeat(np.arange(len(at)), n[at])
            inner = np.arange(len(which)) - np.repeat(np.cumsum(n[at]) - n[at], n[at])
            h = string_hashes(bytes_, (width,))[width][own[which] + inner]
            if ranges > 1:
                mine = np.flatnonzero(_bucket(h, ranges) == k)
                h, which, inner = h[mine], which[mine], inner[mine]
            held.append((anchor[at][which], h, doc[at][which], start[at][which] + inner))
        a, h, d, place = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((place, d, h, a))
        gone = order[_copies(a[order], h[order], d[order], place[order])]
        yield d[gone], place[gone]


def neighbours(d: np.ndarray, place: np.ndarray, most: int = 128) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of documents as runs of at most ``most``: doc, first place, windows."""
    order = np.lexsort((place, d))
    d, place = d[order], place[order]
    keep = _firsts(d, place)
    d, place = d[keep], place[keep]
    lead = np.ones(len(d), bool)
    lead[1:] = (d[1:] != d[:-1]) | (place[1:] != place[:-1] + 1)
    since = np.arange(len(d)) - np.flatnonzero(lead)[np.cumsum(lead) - 1]
    at = np.flatnonzero(lead | (since % most == 0))
    return d[at], place[at], np.diff(np.concatenate([at, [len(d)]]))


def differing_runs(docs: DataFrame, found: DataFrame, width: int, buckets: int) -> DataFrame:
    """Where an anchor has several strings: the repeated windows in them, as bucket (of documents), a0 doc, a1 start."""

    def send(batches):
        for (doc, start, n, anchor, off), b in _met(batches, RUN_TYPES):
            ids, texts = b.column(2).to_pylist(), b.column(3).to_pylist()
            out = [[], [], [], [], [], []]
            for i, text in zip(ids, texts, strict=True):
                if i is None or not text:
                    continue
                lo, hi = np.searchsorted(doc, [i, i + 1])
                at = np.arange(lo, hi)[anchor[lo:hi] != 0]
                if not len(at):
                    continue
                raw = text.encode()
                for j, x in enumerate((anchor, doc, start, n, off)):
                    out[j].append(x[at])
                out[5] += [raw[s : s + k - 1 + width] for s, k in zip(start[at].tolist(), n[at].astype(np.int64).tolist(), strict=True)]
            if out[0]:
                anchors, docs_, starts, ns, offs = (np.concatenate(x) for x in out[:5])
                bucket = _bucket(anchors, buckets)
                order = np.argsort(bucket, kind="stable")
                strings = [out[5][i] for i in order.tolist()]
                bucket = bucket[order]
                edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
                packed = [x[order] for x in (anchors, docs_, starts, ns, offs)]
                for a, z in zip(edges, edges[1:], strict=False):
                    cols = [pa.array([x[a:z].tobytes()], pa.binary()) for x in packed]
                    yield pa.RecordBatch.from_arrays([pa.array([int(bucket[a])], pa.int32()), *cols, pa.array([b"".join(strings[a:z])], pa.binary())], names=["bucket", *[f"a{i}" for i in range(6)]])

    def sort(batches):
        types = [np.uint64, np.int64, np.uint32, np.uint8, np.uint8, np.uint8]
        for _, (anchor, doc, start, n, _, data) in gathered(batches, types):
            n = n.astype(np.int64)
            size = n - 1 + width
            base = np.cumsum(size) - size
            order = np.argsort(anchor, kind="stable")
            lead = _firsts(anchor[order])
            before = np.cumsum(size[order]) - size[order]
            part = (before[lead] // PIECE)[np.cumsum(lead) - 1]  # whole anchors
            for at in np.split(order, np.flatnonzero(np.diff(part)) + 1):
                for d, place in repeated_windows(anchor[at], doc[at], start[at].astype(np.int64), n[at], base[at], data, width):
                    d, place, count = neighbours(d, place)
                    yield from _by_bucket(_doc_bucket(d, buckets), d, place.astype(np.uint32), count.astype(np.uint8), np.zeros(len(d), np.uint64), np.zeros(len(d), np.uint8))

    met = _with_texts(docs, found, buckets, ["a0", "a1", "a2", "a3", "a4"])
    rows = met.mapInArrow(send, "bucket int, a0 binary, a1 binary, a2 binary, a3 binary, a4 binary, a5 binary")
    return per_bucket(rows, sort, "bucket int, a0 binary, a1 binary, a2 binary, a3 binary, a4 binary")


def removed_bytes(length: int, start: np.ndarray, n: np.ndarray, width: int) -> np.ndarray:
    """True for each byte covered by one of the runs' windows."""
    edge = np.zeros(length + 1, np.int32)
    np.add.at(edge, np.minimum(start.astype(np.int64), length), 1)
    np.add.at(edge, np.minimum(start.astype(np.int64) + n.astype(np.int64) - 1 + width, length), -1)
    return np.cumsum(edge[:-1]) > 0


def dedup_substrings(docs: DataFrame, *, width: int = 100, gram: int = 24, buckets: int | None = None, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``, the remaining bytes)."""
    buckets = buckets or bucket_count(docs)
    if not (gram < width <= 127 + gram and 2 * width - gram <= 3 << (width.bit_length() - 1)):
        raise ValueError("three power-of-two hashes must cover a run of windows")
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    found = stored(repeated_runs(docs.filter("doc_id is not null"), width, gram, buckets), "runs")
    more = differing_runs(docs.filter("doc_id is not null"), found, width, buckets)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text

    def cut(batches):
        for (doc, start, n, anchor, _), b in _met(batches, RUN_TYPES):
            rows = []
            for i, text in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                raw = (text or "").encode()
                kept, gone, spans = raw, 0, 0
                if i is not None and raw:
                    lo, hi = np.searchsorted(doc, [i, i + 1])
                    at = np.arange(lo, hi)[anchor[lo:hi] == 0]
                    if len(at):
                        mask = removed_bytes(len(raw), start[at], n[at], width)
                        gone = int(mask.sum())
                        spans = int((mask & ~np.concatenate([[False], mask[:-1]])).sum())
                        kept = np.frombuffer(raw, np.uint8)[~mask].tobytes()
                rows.append((i, len(raw), gone, spans, hashlib.sha256(kept).hexdigest(), kept)[: len(names)])
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=False)], names=names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    every = found.union(more)
    return _with_texts(docs, every, buckets, ["a0", "a1", "a2", "a3", "a4"]).mapInArrow(cut, schema)
