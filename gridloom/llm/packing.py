"""Best-fit-decreasing packing of tokenised documents into sequences.

Tokenising happens where the texts lie: a task encodes each distinct run of
characters between white space once (white space always starts a new token
group, so the ids are those of the whole text), cuts what is longer than a
sequence and numbers its pieces within each length. Pieces and their ids go to
the shared folder.

Pieces of one length are interchangeable, so the best fit needs only the number
of pieces of each length, at most ``capacity`` numbers whatever the corpus.
Lengths are taken in falling order; a segment tree over remaining capacities
finds the tightest open bins in logarithmic time, and a run of equal pieces
goes to a run of equally full bins at once. The bins are exactly those of the
best-fit decreasing rule over the whole corpus, one piece at a time. The plan
says for each length which ranks go where; a piece's rank is its number within
its task plus what earlier tasks have, so no task holds more than its own
pieces and no piece is sorted.

Defined results: a null text is an empty one, and every row is a document, with
a repeated or null id too; an empty document is its end token alone; an empty
table gives an empty result; columns besides doc_id and text are left out. Texts
of any length are encoded in slices.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blobs import chunks
from .common import stored

#: The characters with the White_Space property.
SPACE = "\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
RUN = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
WORD = re.compile(f" [^{SPACE}]")
EDGE = re.compile(f"(?<=[^{SPACE}])[{SPACE}]")
SLICE = 1 << 20  # characters of a text encoded at a time
KEPT = 1 << 20  # distinct runs whose ids a worker remembers


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    return t


def slices(text: str) -> Iterator[str]:
    """A text in slices that end where a run of white space starts."""
    at = 0
    while len(text) - at > SLICE:
        edge = EDGE.search(text, at + SLICE)
        if not edge:
            break
        yield text[at : edge.start()]
        at = edge.start()
    yield text[at:]


class Encoder:
    """Token ids (little-endian 32-bit) of texts. Of the runs met last, up to ``KEPT`` keep their ids, in two generations."""

    def __init__(self, path: str):
        self.tokenizer, self.known, self.older = _tokenizer(path), {}, {}
        (self.line_end,) = self.tokenizer.encode("\n", add_special_tokens=False).ids

    def __call__(self, texts: list[str]) -> list[bytes]:
        out: list[list[bytes]] = [[] for _ in texts]
        held, size = [], 0
        for i, text in enumerate(texts):
            for part in slices(text):
                held.append((i, RUN.findall(part)))
                size += len(part)
                if size > SLICE:
                    self._add(held, out)
                    held, size = [], 0
        self._add(held, out)
        return [b"".join(x) for x in out]

    def _add(self, held: list[tuple[int, list[str]]], out: list[list[bytes]]) -> None:
        found = [list(map(self.known.get, of)) for _, of in held]
        lacks = {r: self.older.get(r) for (_, of), got in zip(held, found, strict=True) if None in got for r, ids in zip(of, got, strict=True) if ids is None}
        new = [r for r, ids in lacks.items() if ids is None]
        lacks.update(zip(new, self._encoded(new), strict=True))
        for (i, of), got in zip(held, found, strict=True):
            out[i].append(b"".join([lacks[r] if ids is None else ids for r, ids in zip(of, got, strict=True)] if None in got else got))
        self.known.update(lacks)
        if len(self.known) > KEPT // 2:
            self.known, self.older = {}, self.known


    def _encoded(self, runs: list[str]) -> list[bytes]:
        """Ids of runs. Those of one space and a word are joined by line ends, which are tokens of their own there, to be encoded many at once."""
        out: dict[int, bytes] = {}
        words = [i for i, r in enumerate(runs) if WORD.match(r)]
        groups = [words[a : a + 64] for a in range(0, len(words), 64)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast(["\n".join([runs[i] for i in g]) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = (4 * np.flatnonzero(ids == self.line_end)).tolist()
            raw = ids.tobytes()
            out.update(zip(group, [raw[a:z] for a, z in zip([0, *[x + 4 for x in ends]], [*ends, len(raw)], strict=True)], strict=True))
        rest = [i for i in range(len(runs)) if i not in out]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([runs[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, "<u4").tobytes()
        return [out[i] for i in range(len(runs))]


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One for each worker process, which runs many tasks."""
    return Encoder(path)


def _pieces(path: str, capacity: int, end: int):
    names = ["doc_id", "piece", "start", "length", "ids", "ids_crc32", "task", "nth"]
    kinds = [None, pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = _encoder(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        last = np.array([end], "<u4").tobytes()
        for part, texts in chunks(batches, 1):
            of, cols = [], [[] for _ in names[1:]]
            for i, ids in enumerate(encode([t or "" for t in texts])):
                ids += last
                n = len(ids) // 4
                first = (n - 1) % capacity + 1
                for piece, start in enumerate([0, *range(first, n, capacity)]):
                    mine = ids[4 * start : 4 * (start + capacity if piece else first)]
                    length = len(mine) // 4
                    of.append(i)
                    for c, v in zip(cols, (piece, start, length, mine, zlib.crc32(mine), task, int(seen[length])), strict=True):
                        c.append(v)
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of, pa.int64())), *[pa.array(c, k) for c, k in zip(cols, kinds[1:], strict=True)]], names=names)

    return run


class Capacities:
    """A segment tree over remaining capacities; its leaves hold runs of bins (first, number)."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        self.open = [0] * (2 * self.size)

    def _count(self, left: int, by: int) -> None:
        at = left + self.size
        while at:
            self.open[at] += by
            at >>= 1

    def put(self, left: int, first: int, bins: int) -> None:
        if left and bins:
            self.runs[left].append((first, bins))
            self._count(left, 1)

    def take(self, left: int) -> tuple[int, int]:
        self._count(left, -1)
        return self.runs[left].pop()

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of an open bin that takes ``length``."""
        at = length + self.size
        if not self.open[at]:
            while at > 1 and (at & 1 or not self.open[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.open[2 * at] else 2 * at + 1
        return at - self.size


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, sequence, pieces in each sequence, offset) of every run, from the number of pieces of each length."""
    bins, plan, made = Capacities(capacity), [], 0
    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        rank, rest = 0, counts[length]
        while rest:
            left = bins.tightest(length)
            if left is None:
                left, number = capacity, -(-rest // (capacity // length))
                first, made = made, made + number
            else:
                first, number = bins.take(left)
            each = left // length
            full = min(number, rest // each)
            if full:
                plan.append((length, rank, first, each, capacity - left))
                bins.put(left - each * length, first, full)
                rank, rest = rank + full * each, rest - full * each
            used = full
            if full < number and rest:  # fewer than a bin takes
                plan.append((length, rank, first + full, rest, capacity - left))
                bins.put(left - rest * length, first + full, 1)
                rest, used = 0, full + 1
            bins.put(left, first + used, number - used)
    return plan


def pack_documents(docs: DataFrame, tokenizer: str, *, capacity: int = 1024, end: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian 32-bit), ids_crc32, sequence_id, offset: one row for each piece.

    ``tokenizer``: path, on driver and workers, of a byte-level BPE file, whose
    words begin with the white space before them. Documents end with ``end``; those of more than ``capacity`` tokens are cut, the first piece
    being the shorter one.
    """
    key = docs.schema["doc_id"].dataType.simpleString()
    pieces = docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, capacity, end), f"doc_id {key}, piece int, start long, length int, ids binary, ids_crc32 long, task int, nth long")
    pieces = stored(pieces, "pieces")
    tallies = stored(pieces.groupBy("task", "length").agg((F.max("nth") + 1).alias("n")), "tallies")
    counts = {r["length"]: r["n"] for r in tallies.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    places = docs.sparkSession.createDataFrame(best_fit(counts, capacity), "length int, first long, sequence long, each long, offset long")
    places = places.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("first", "sequence", "each", "offset"))).alias("places"))
    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    before = tallies.select("task", "length", F.coalesce(earlier, F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["task", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    # The plan's size depends on ``capacity`` alone.
    placed = ranked.join(F.broadcast(places), "length").withColumn("at", F.element_at(F.filter("places", lambda p: p["first"] <= F.col("rank")), -1))
    j = F.col("rank") - F.col("at.first")
    return placed.select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids", "ids_crc32",
        (F.col("at.sequence") + ((j - j % F.col("at.each")) / F.col("at.each")).cast("long")).alias("sequence_id"),
        (F.col("at.offset") + j % F.col("at.each") * F.col("length")).alias("offset"),
    )


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, ids, starts: each sequence's tokens, and where its pieces start; at most a capacity's tokens a row."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.aggregate("p", F.lit(b""), lambda s, x: F.concat(s, x["ids"])).alias("ids"), F.transform("p", lambda x: x["offset"]).alias("starts"))
