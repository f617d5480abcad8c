"""Line dedup with two Bloom filters.

1. Every task hashes the keys of its documents' lines and sets bits in two
   sparse filters, keys it saw once and keys it saw in two documents. Filters
   are cut into slices, as many as the number of long lines asks for; a slice's
   partial bit lists meet in one task, which ors them: a bit set by two tasks
   moves to the twice filter.
2. The twice filter is broadcast while it is small (``broadcast_bytes``). A
   larger one stays where it is, by slice, and the hashes of lines go to their
   slices. Either way only suspected repeats are shuffled with their text:
   exact count of documents and the largest doc_id. First (key, doc_id) pairs
   are made distinct, then keys are counted from partial counts, so a line of
   all documents is no hot key.
3. Keys that repeat often enough, with the document that keeps them, are
   broadcast while they are small, and lines go where they lie. Beyond that
   they are joined with the suspects, salted, and then with the documents.

A false positive of a filter only lets one more line through; results are
exact, and the same on every path.

Defined results: a null or empty text is one empty line; a null doc_id counts
as no document (its lines stay); rows with a repeated doc_id are one document
in the counts and lose the same lines; an empty table gives an empty result;
line order and other lines are untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

SLICE_BITS = 1 << 19  # 64 KB of bits
HASHES = 4
SALTS = 32


def line_key(line: bytes) -> bytes:
    return line.strip().lower()  # bytes methods: ASCII white space and A-Z only


def long_keys(text: str | None, least: int) -> set[bytes]:
    """Distinct keys of at least ``least`` code points."""
    keys = {line_key(x) for x in (text or "").encode().split(b"\n") if len(x) >= least}
    return {k for k in keys if len(k) >= least and (len(k) >= 4 * least or len(k.decode()) >= least)}


def key_hashes(keys) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))


def bit_positions(h: np.ndarray, bits: int) -> np.ndarray:
    """n x HASHES bit numbers: the hash's slice, then double hashing inside it."""
    place = h % np.uint64(bits // SLICE_BITS)
    a, b = (h >> np.uint64(20)) & np.uint64(0x3FFFFF), (h >> np.uint64(42)) | np.uint64(1)
    inner = (a[:, None] + b[:, None] * np.arange(HASHES, dtype=np.uint64)) % np.uint64(SLICE_BITS)
    return place[:, None] * np.uint64(SLICE_BITS) + inner


def _by_slice(bits: np.ndarray) -> Iterator[tuple[int, bytes]]:
    bits = np.unique(bits)
    which = (bits // SLICE_BITS).astype(np.int64)
    cuts = np.flatnonzero(np.diff(which)) + 1
    for part in np.split(bits, cuts) if len(bits) else []:
        yield int(part[0] // SLICE_BITS), (part % SLICE_BITS).astype(np.uint32).tobytes()


def _local_filters(bits: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (slice, twice, positions); flushed now and then to bound memory. Two flushes of one task merge like two tasks."""
        once: set[bytes] = set()
        twice: set[bytes] = set()

        def flush():
            rows = [(s, False, p) for s, p in _by_slice(bit_positions(key_hashes(once), bits).ravel())]
            rows += [(s, True, p) for s, p in _by_slice(bit_positions(key_hashes(twice), bits).ravel())]
            once.clear()
            twice.clear()
            if rows:
                a, b, c = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.bool_()), pa.array(c, pa.binary())], names=["slice", "twice", "positions"])

        held = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                keys = long_keys(text, least)
                twice |= keys & once
                once |= keys
                held += sum(map(len, keys))
                if held > 32 << 20:
                    yield from flush()
                    held = 0
        yield from flush()

    return run


def _merge_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Or the partial filters of whole slices; two bit arrays per slice are held, nothing else."""
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for b in batches:
        for s, twice, pos in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            one, two = held.setdefault(s, (np.zeros(SLICE_BITS, bool), np.zeros(SLICE_BITS, bool)))
            p = np.frombuffer(pos, np.uint32)
            if twice:
                two[p] = True
            else:
                two[p[one[p]]] = True
                one[p] = True
    done = [(s, np.packbits(two).tobytes()) for s, (_, two) in held.items() if two.any()]
    if done:
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in done], pa.int32()), pa.array([x for _, x in done], pa.binary())], names=["slice", "bits"])


def filter_bits(texts: DataFrame, least: int, bits_per_line: float) -> int:
    """Bits for as many keys as there are long lines, in whole slices."""
    lines = texts.agg(F.sum(F.regexp_count("text", F.lit(rf"[^\n]{{{least},}}")))).first()[0] or 0
    return SLICE_BITS * max(1, -int(-lines * bits_per_line // SLICE_BITS))


def twice_slices(texts: DataFrame, *, least: int, bits: int) -> DataFrame:
    """slice, bits: the keys that may occur in two documents."""
    part = texts.mapInArrow(_local_filters(bits, least), "slice int, twice boolean, positions binary")
    return part.repartition("slice").mapInArrow(_merge_slices, "slice int, bits binary")


def _on(packed: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Rows of bit numbers that are all set."""
    return ((packed[p >> np.uint64(3)] >> (np.uint64(7) - (p & np.uint64(7))).astype(np.uint8)) & 1).all(axis=1)


def _found(ids: list, keys: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.string())], names=["doc_id", "key"])


def _suspects(filt, bits: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = filt.value
        for b in batches:
            ids, keys = [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = list(long_keys(text, least))
                if own and i is not None:
                    for k in np.flatnonzero(_on(f, bit_positions(key_hashes(own), bits))):
                        ids.append(i)
                        keys.append(own[k].decode())
            yield _found(ids, keys)

    return run


def _sent_hashes(bits: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """slice, hashes and doc_ids of long lines, a row for each slice of a batch."""
        for b in batches:
            hashes, ids = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = long_keys(text, least)
                if own and i is not None:
                    hashes.append(key_hashes(own))
                    ids.append(np.full(len(own), i, np.int64))
            h, doc = np.concatenate(hashes), np.concatenate(ids)
            which = (h % np.uint64(bits // SLICE_BITS)).astype(np.int32)
            order = np.argsort(which, kind="stable")
            parts = np.split(order, np.flatnonzero(np.diff(which[order])) + 1) if len(order) else []
            cols = [pa.array([int(which[p[0]]) for p in parts], pa.int32()), *[pa.array([x[p].tobytes() for p in parts], pa.binary()) for x in (h, doc)]]
            yield pa.RecordBatch.from_arrays(cols, names=["slice", "a", "b"])

    return run


def _asked(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by slice, its filter (without ``b``) first: doc_id and hash of suspected lines."""
        now, packed = None, None
        for batch in batches:
            for s, a, b in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if b is None:
                    now, packed = s, np.frombuffer(a, np.uint8)
                elif s == now:  # else no key of the slice was seen twice
                    h, doc = np.frombuffer(a, np.uint64), np.frombuffer(b, np.int64)
                    hit = _on(packed, bit_positions(h, bits) % np.uint64(SLICE_BITS))
                    yield pa.RecordBatch.from_arrays([pa.array(doc[hit]), pa.array(h[hit].view(np.int64))], names=["doc_id", "h"])

    return run


def _named(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """doc_id, text, hashes -> the lines of these hashes."""
        for b in batches:
            ids, keys = [], []
            for i, text, hs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                wanted = set(hs)
                own = list(long_keys(text, least))
                for k, h in zip(own, key_hashes(own).view(np.int64).tolist(), strict=True):
                    if h in wanted:
                        ids.append(i)
                        keys.append(k.decode())
            yield _found(ids, keys)

    return run


def suspected_lines(docs: DataFrame, *, least: int, bits: int, broadcast_bytes: int) -> DataFrame:
    """doc_id, key: lines whose key may be in two documents."""
    spark, texts = docs.sparkSession, docs.selectExpr("cast(doc_id as long) doc_id", "text")
    slices = twice_slices(texts.select("text"), least=least, bits=bits)
    if bits // 8 <= broadcast_bytes:
        packed = np.zeros(bits // 8, np.uint8)
        for row in slices.collect():
            packed[row["slice"] * SLICE_BITS // 8 : (row["slice"] + 1) * SLICE_BITS // 8] = np.frombuffer(row["bits"], np.uint8)
        return texts.mapInArrow(_suspects(spark.sparkContext.broadcast(packed), bits, least), "doc_id long, key string")
    asked = texts.mapInArrow(_sent_hashes(bits, least), "slice int, a binary, b binary").selectExpr("slice", "1 kind", "a", "b")
    asked = slices.selectExpr("slice", "0 kind", "bits a", "cast(null as binary) b").union(asked).repartition("slice").sortWithinPartitions("slice", "kind")
    found = asked.mapInArrow(_asked(bits), "doc_id long, h long").groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("h").alias("hs"))
    return texts.join(found, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "hs").mapInArrow(_named(least), "doc_id long, key string")


def _without(gone, at: int):
    """Text is the last column, doc_id the one at ``at``; lines go whose key another document keeps."""

    def keys_of(i: int | None, text: str | None, keepers: dict[bytes, int]) -> set[bytes]:
        if i is None or not keepers:
            return set()
        return {k for k in map(line_key, (text or "").encode().split(b"\n")) if keepers.get(k, i) != i}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keepers = gone.value
        for b in batches:
            last = b.num_columns - 1
            yield _rest(b, last, [keys_of(i, text, keepers) for i, text in zip(b.column(at).to_pylist(), b.column(last).to_pylist(), strict=True)])

    return run


def _dropped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column holds the keys to drop, the one before it the text."""
    for b in batches:
        yield _rest(b, b.num_columns - 2, ({k.encode() for k in keys or ()} for keys in b.column(b.num_columns - 1).to_pylist()))


def _rest(b: pa.RecordBatch, at: int, gone) -> pa.RecordBatch:
    """The columns before ``at``, then text without the lines of its gone keys, n_lines, n_dropped."""
    texts, totals, dropped = [], [], []
    for text, keys in zip(b.column(at).to_pylist(), gone, strict=True):
        kept = lines = (text or "").encode().split(b"\n")
        if keys:
            kept = [x for x in lines if line_key(x) not in keys]
        texts.append(b"\n".join(kept).decode() if keys else text)
        totals.append(len(lines))
        dropped.append(len(lines) - len(kept))
    arrays = [*b.columns[:at], pa.array(texts, pa.string()), pa.array(totals, pa.int64()), pa.array(dropped, pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, names=[*b.schema.names[:at], "text", "n_lines", "n_dropped"])


def dedup_lines(docs: DataFrame, *, least: int = 40, min_docs: int = 5, bits_per_line: float = 16, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """The columns of ``docs`` with ``text`` less its repeated lines, plus n_lines and n_dropped."""
    spark = docs.sparkSession
    bits = filter_bits(docs, least, bits_per_line)
    suspects = stored(suspected_lines(docs, least=least, bits=bits, broadcast_bytes=broadcast_bytes), "suspects")
    counted = suspects.distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper"))
    keys = stored(counted.filter(F.col("n") >= min_docs).select("key", "keeper"), "keys")
    rest = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    out = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest) + ", text string, n_lines long, n_dropped long"
    if (keys.agg(F.sum(F.octet_length("key") + 64)).first()[0] or 0) <= broadcast_bytes:
        keepers = spark.sparkContext.broadcast({r["key"].encode(): r["keeper"] for r in keys.collect()})
        return docs.select(*rest, "text").mapInArrow(_without(keepers, rest.index("doc_id")), out)
    salted = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    drops = suspects.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"]).filter(F.col("doc_id") != F.col("keeper"))
    drops = drops.groupBy(F.col("doc_id").alias("_drop_id")).agg(F.collect_set("key").alias("_drop_keys"))
    joined = docs.join(drops, docs["doc_id"] == drops["_drop_id"], "left").select(*rest, "text", "_drop_keys")
    return joined.mapInArrow(_dropped, out)
