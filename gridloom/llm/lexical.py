"""Ranked lexical search by MaxScore over shards of documents.

Queries (``items``) are read a bounded block at a time; only their terms need
postings. Every task turns its documents into packed postings of those terms,
some megabytes of text a row, written to the shared folder with the counts that
make up the statistics: documents, terms and document frequencies over the whole
corpus, added up by Spark. A second pass searches the postings. A term's upper
bound in a shard is its best posting there. For each item terms are ordered by
their bounds; the longest run of lowest bounds whose sum stays under the score
of the item's k-th best document so far is non-essential. Documents are
gathered from essential postings only, and non-essential ones are probed, from
the highest bound down, while a document with all that is left can still
qualify. A task goes on with its k-th best scores from one shard to the next
and passes on at most ``k`` documents an item.

Scores are integers. With the document's ``n`` terms of all ``L`` in ``N``
documents, ``m = 100 - 50 + 50 n N div L``; a term in ``df`` documents weighs
``w = floor(1000 ln((2 N + 2) / (2 df + 1)))`` and adds
``w * (10^9 tf div (1000 tf + 20 m))``.

Defined results: every row is a document, repeated ids too; one with a null id
counts in the statistics and is not ranked, as it cannot be named; a null text
has no term; items with a null id are left out and rows of one item id are one
item; equal scores go by id; an item whose terms are in no document has no row;
empty tables give an empty result; other columns are left out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blobs import chunks, packed, unpacked
from .common import scratch_path, stored

#: What splits terms becomes a space: every ASCII character but letters and digits. A-Z are lower-cased.
SPLIT = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
SLICE = 1 << 22  # bytes of a text split at a time
SHARD = 16 << 20  # bytes of text whose postings are one row
ARRAYS = ("ids", "n", "terms", "df", "lens", "docs", "tf")
POSTINGS = "n_docs long, n_terms long, " + ", ".join(f"{a} binary" for a in ARRAYS)
FOUND = "item long, doc_id long, score long"


def terms_of(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some megabytes at a time."""
    raw, at = raw.translate(SPLIT), 0
    while at < len(raw):
        to = raw.find(b" ", at + SLICE) if len(raw) - at > SLICE else -1
        yield raw[at : to if to >= 0 else None].split()
        at = to if to >= 0 else len(raw)


def _postings(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of doc_id, text (as bytes) -> a row of packed postings for each shard."""
        of = vocabulary.value.get
        for part, texts in chunks(batches, 1, SHARD):
            doc_ids = part.column(0).to_pylist()
            n_docs = n_terms = 0
            ids, lengths, term, doc, tf, seen = [], [], [], [], [], Counter()
            for i, raw in enumerate(texts):
                n, hits = 0, Counter()
                for words in terms_of(raw or b""):
                    n += len(words)
                    hits.update(map(of, words))
                hits.pop(None, None)
                if not n:
                    continue
                n_docs, n_terms = n_docs + 1, n_terms + n
                seen.update(hits.keys())
                if doc_ids[i] is not None:
                    term += hits.keys()
                    tf += hits.values()
                    doc += [len(ids)] * len(hits)
                    ids.append(doc_ids[i])
                    lengths.append(n)
            term, doc, tf = np.array(term, np.int32), np.array(doc, np.int32), np.array(tf, np.int64)
            order = np.lexsort((doc, term))
            terms = np.array(sorted(seen), np.int32)
            lens = np.searchsorted(term[order], terms, "right") - np.searchsorted(term[order], terms, "left")
            arrays = (np.array(ids, np.int64), np.array(lengths, np.int64), terms, np.array([seen[t] for t in terms.tolist()], np.int64), lens.astype(np.int64), doc[order], tf[order])
            cols = [pa.array([n_docs], pa.int64()), pa.array([n_terms], pa.int64()), *[pa.array([packed(a)], pa.binary()) for a in arrays]]
            yield pa.RecordBatch.from_arrays(cols, names=["n_docs", "n_terms", *ARRAYS])

    return run


def _frequencies(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for b in batches:
            for terms, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                df[unpacked(terms, np.int32)] += unpacked(n, np.int64)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], names=["term", "df"])

    return run


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_norm(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of documents with n terms; in whole numbers of any size where 64 bits do not do."""
    if len(n) and int(n.max()) * 50 * n_docs >= 1 << 63:
        return np.array([100 - 50 + 50 * int(x) * n_docs // n_terms for x in n], np.int64)
    return 100 - 50 + 50 * n * n_docs // max(n_terms, 1)


class Shard:
    """Postings of one row with every posting's part of a score, and the best of each term."""

    def __init__(self, row: dict, weights: np.ndarray, n_docs: int, n_terms: int):
        kinds = (np.int64, np.int64, np.int32, np.int64, np.int64, np.int32, np.int64)
        self.ids, n, terms, _, lens, self.docs, tf = (unpacked(row[a], k) for a, k in zip(ARRAYS, kinds, strict=True))
        held = lens > 0
        terms, lens = terms[held], lens[held]
        norm = length_norm(n, n_docs, n_terms)
        self.part = np.repeat(weights[terms], lens) * (1_000_000_000 * tf // (1000 * tf + 20 * norm[self.docs]))
        ends = np.cumsum(lens)
        self.span = dict(zip(terms.tolist(), zip((ends - lens).tolist(), ends.tolist(), strict=True), strict=True))
        self.bound = dict(zip(terms.tolist(), np.maximum.reduceat(self.part, ends - lens).tolist() if len(terms) else [], strict=True))

    def search(self, terms: list[int], least: int) -> tuple[np.ndarray, np.ndarray]:
        """(score, id) of documents whose score is above 0 and at least ``least``, and of no other one."""
        order = sorted((self.bound[t], t) for t in terms if t in self.bound)
        sums = np.cumsum([b for b, _ in order])
        few = int(np.searchsorted(sums, least, "left"))  # the first terms, whose bounds together stay below
        score = np.zeros(len(self.ids), np.int64)
        for _, t in order[few:]:
            a, z = self.span[t]
            score[self.docs[a:z]] += self.part[a:z]
        may = np.flatnonzero(score)
        for i in range(few - 1, -1, -1):
            may = may[score[may] + sums[i] >= least]
            if not len(may):
                break
            a, z = self.span[order[i][1]]
            docs = self.docs[a:z]
            at = np.minimum(np.searchsorted(docs, may), len(docs) - 1)
            hit = docs[at] == may
            score[may[hit]] += self.part[a:z][at[hit]]
        may = may[score[may] >= max(least, 1)]
        return score[may], self.ids[may]


def _searched(asked, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, n_docs, n_terms = asked.value
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in items]
        for b in batches:
            for i in range(b.num_rows):
                shard = Shard({a: b.column(j)[i].as_py() for j, a in enumerate(ARRAYS)}, weights, n_docs, n_terms)
                for at, (_, terms) in enumerate(items):
                    score, ids = best[at]
                    new = shard.search(terms, int(score[-1]) if len(score) == k else 0)
                    if len(new[0]):
                        score, ids = np.concatenate([score, new[0]]), np.concatenate([ids, new[1]])
                        order = np.lexsort((ids, -score))[:k]
                        best[at] = score[order], ids[order]
        cols = [np.repeat([i for i, _ in items], [len(s) for s, _ in best]), np.concatenate([x for _, x in best]), np.concatenate([s for s, _ in best])]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["item", "doc_id", "score"])

    return run


def search_documents(docs: DataFrame, items: DataFrame, *, k: int = 50, block: int = 4 << 20) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``k`` highest-scoring documents.

    ``docs``: doc_id, text; ``items``: item_id, text. About ``block`` bytes of
    items are searched at a time; a task holds their terms and best documents.
    """
    spark = docs.sparkSession
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null")
    size = asked.agg(F.sum(F.octet_length("text")).alias("size"), F.count(F.lit(1)).alias("n")).first()
    blocks = -(-max(size["size"] or 0, size["n"] * 64) // block)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(max(blocks, 1))))
    where = scratch_path(spark, "ranked")
    result = "item_id long, rank int, doc_id long, score long"
    spark.createDataFrame([], result).write.parquet(where)
    for i in range(blocks):
        terms: dict[int, set[bytes]] = {}
        for r in asked.filter(F.col("block") == i).collect():
            of = terms.setdefault(r["item_id"], set())
            for words in terms_of((r["text"] or "").encode()):
                of.update(words)
        vocabulary = {t: n for n, t in enumerate(sorted(set().union(*terms.values())))}
        if not vocabulary:
            continue
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
        mine = stored(texts.mapInArrow(_postings(spark.sparkContext.broadcast(vocabulary)), POSTINGS), "postings")
        total = mine.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        if not total[0]:
            continue
        counts = mine.select("terms", "df").mapInArrow(_frequencies(len(vocabulary)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()  # the block's terms
        weights = np.zeros(len(vocabulary), np.int64)
        for r in counts:
            weights[r["term"]] = weight(total[0], r["df"])
        query = spark.sparkContext.broadcast(([(i, [vocabulary[t] for t in of]) for i, of in sorted(terms.items())], weights, total[0], total[1]))
        found = mine.select(*ARRAYS).mapInArrow(_searched(query, k), FOUND)
        w = Window.partitionBy("item").orderBy(F.col("score").desc(), "doc_id")
        found = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        found.select(F.col("item").alias("item_id"), "rank", "doc_id", "score").write.mode("append").parquet(where)
    return spark.read.schema(result).parquet(where)
