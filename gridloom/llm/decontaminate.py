"""Benchmark decontamination by template canonicalisation.

A text becomes a sequence of words in which numbers, names and units are typed
placeholders, so a question that was re-parameterised (other numbers, other
names) keeps its template. Windows of template words are hashed and joined with
the benchmark's window hashes. Matches on one diagonal (document position minus
item position) and on those up to ``drift`` beside it, for inserted or left-out
words, are one alignment. An alignment counts if it covers ``coverage`` of the
item's windows and its slots are consistent: in the windows that matched, and
only there, one value of the item always becomes the same value in the
document. Two values may become one.

Every capitalised word is a name, at the start of a sentence too: that makes
slots of words like "The", which keep their value in a copy. Texts are also
read as lower-cased words, which finds copies with changed case and items of
numbers or names; windows with over half placeholders are searched by their
words alone.

Window lengths: ``window`` words for items that have room for it after one
changed word in their middle (3 * ``window`` - 3 words), ``short`` words for
items that have room for that, and the item's own length, ``window`` at most,
below.

Items that differ in the values of their slots only (same template, same slots
equal) are one template class: documents are reported with the class, not with
each of its members, and ``template_classes`` lists the membership.

All DataFrame expressions. A document's windows are hashed by doubling (two
halves of a window make its hash) and kept as arrays; a byte map of the
benchmark's hashes drops nearly all of them in place, so that only likely
matches become rows. The map and the benchmark's side are sent along only while
they have at most ``broadcast_rows`` windows; beyond that all window hashes are
shuffled. Only documents with matches are read again for their own words.

Defined results: null or empty texts never match; rows with a repeated doc_id
are one document, and so are those with a null doc_id; items with a null id or
no words take no part; an item repeated under one id counts once for each
different text; of several equally good alignments the one at the earliest
place is kept; an empty table gives an empty result; other columns of the input
are left out.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Units that may follow a number.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb lbs oz ml l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "meter meters metre metres kilometer kilometers mile miles inch inches foot feet yard yards gram grams kilogram kilograms pound pounds ounce ounces "
    "dollar dollars cent cents euro euros percent degree degrees celsius fahrenheit mph kmh kph hz khz mhz w kw v a k c f"
).split()
NUMBER, NAME, UNIT = "<n>", "<p>", "<u>"
BRACKETS = r"""[()\[\]{}<>"'*#|]+"""
STOPS = "[.,;:!?]+"
FEW_DOCS = 1_000_000  # ids that may be broadcast


def canonical(df: DataFrame, *keep: str) -> DataFrame:
    """``keep``, words (as they stand), template and plain: arrays with an entry for each word and an empty one at both ends.

    Every rule is one pass over the whole text that starts at a fixed
    character, which regular expressions find fast.
    """
    text = F.coalesce("text", F.lit(""))
    spaced = F.trim(F.regexp_replace(text, r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " "))
    d = df.select(*keep, F.concat(F.lit(" "), spaced, F.lit(" ")).alias("_s"))
    d = d.withColumn("_p", F.regexp_replace("_s", BRACKETS, ""))
    t = F.regexp_replace("_p", r" [$€£]?[+-]?\p{N}[\p{N}.,:/-]*%?(?=[.,;:!? ])", f" {NUMBER}")
    units = "|".join(sorted(UNITS, key=lambda u: (-len(u), u)))
    t = F.regexp_replace(t, rf"<n> (?:{units})(?=[.,;:!? ])", f"{NUMBER} {UNIT}")
    t = F.regexp_replace(t, r" \p{Lu}[\p{L}-]*", f" {NAME}")
    tidy = lambda c: F.split(F.lower(F.regexp_replace(c, STOPS, "")), " ")
    return d.select(*keep, F.split("_s", " ").alias("words"), tidy(t).alias("template"), tidy(F.col("_p")).alias("plain"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, although the optimiser would inline it into every lambda."""
    return F.transform(F.array(value), body)[0]


def window_hashes(df: DataFrame, words: str, lengths: list[int], *keep: str) -> DataFrame:
    """``keep`` and, for each length n, g{n}: the hashes of all windows of n entries of ``words``, by doubling."""
    d = df.select(*keep, F.transform(words, lambda w: F.xxhash64(w)).alias("g1"))
    done = {1}

    def make(n: int) -> None:
        nonlocal d
        if n in done:
            return
        done.add(n)
        a = 1 << ((n - 1).bit_length() - 1)  # a power of two below n
        make(a)
        make(n - a)
        size = F.greatest(F.size(f"g{n - a}") - a, F.lit(0))
        d = d.withColumn(f"g{n}", F.zip_with(F.slice(f"g{a}", 1, size), F.slice(f"g{n - a}", a + 1, size), lambda x, y: F.xxhash64(x, y)))

    for n in lengths:
        make(n)
    return d.select(*keep, *[f"g{n}" for n in lengths])


def _slot_value(kind: Column, word: Column) -> Column:
    """A slot's value, without case and marks; one dollar, two dollars."""
    w = F.lower(F.regexp_replace(word, rf"{BRACKETS}|{STOPS}", ""))
    return F.when(kind == UNIT, F.regexp_replace(w, "s$", "")).otherwise(w)


def _slots(template: Column, words: Column) -> Column:
    """For each word 0, or the number of its slot value among the item's different ones."""
    value = F.zip_with(template, words, lambda t, w: F.when(t.startswith("<"), F.concat(t, _slot_value(t, w))))
    return _let(value, lambda v: F.transform(v, lambda x: F.coalesce(F.array_position(F.array_distinct(F.array_compact(v)), x), F.lit(0)).cast("int")))


def _items(benchmark: DataFrame, window: int, short: int) -> DataFrame:
    """class_id, item_id, template, plain, slots, n (window length)."""
    has_words = F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    d = canonical(benchmark.filter(F.col("item_id").isNotNull() & has_words).select("item_id", "text").distinct(), "item_id")
    d = d.select("item_id", *[F.slice(c, 2, F.size(c) - 2).alias(c) for c in ("words", "template", "plain")])
    size = F.size("words")
    n = F.when(size >= 3 * window - 3, window).when(size >= 3 * short - 3, short).otherwise(F.least(size, F.lit(window)))
    d = d.select("item_id", "template", "plain", _slots(F.col("template"), F.col("words")).alias("slots"), n.cast("int").alias("n"))
    d = stored(d.withColumn("key", F.to_json(F.struct("template", "slots"))), "items")
    return d.join(d.groupBy("key").agg(F.min("item_id").alias("class_id")), "key").drop("key")


def template_classes(benchmark: DataFrame, *, window: int = 8, short: int = 5) -> DataFrame:
    """item_id, class_id: which template class each item belongs to; a class is named by its smallest item."""
    return _items(benchmark, window, short).select("item_id", "class_id").distinct()


def _grams(items: DataFrame, lengths: list[int]) -> DataFrame:
    """h, class_id, item_at, own (by the template), n, t, s: a window's hash, place, template words and slots."""
    out = []
    for n in lengths:
        for words in ("template", "plain"):
            g = window_hashes(items.filter(F.col("n") == n), words, [n], "class_id", "template", "slots").select("*", F.posexplode(f"g{n}").alias("item_at", "h"))
            part = lambda c: F.slice(c, F.col("item_at") + 1, n)  # noqa: E731, B023
            g = g.select("h", "class_id", "item_at", F.lit(words == "template").alias("own"), F.lit(n).alias("n"), part("template").alias("t"), part("slots").alias("s"))
            literal = F.size(F.filter("t", lambda x: ~x.startswith("<"))) * 2 >= n
            out.append(g.filter(literal) if words == "template" else g)
    return reduce(DataFrame.unionByName, out).distinct()


def _byte_map(hashes: list[int]) -> bytes:
    """One byte for each value of a hash's last bits, 1 where the list has it: 16 bytes a hash or more."""
    size = 1 << max(12, (16 * len(hashes) - 1).bit_length())
    at = bytearray(size)
    for h in hashes:
        at[h & (size - 1)] = 1
    return bytes(at)


def _met(docs: DataFrame, grams: DataFrame, lengths: list[int], small: bool) -> DataFrame:
    """doc_id, _text (a hash of it), at, h: windows whose hash the benchmark has."""
    keep = ("doc_id", "_text")
    d = canonical(docs.withColumn("_text", F.xxhash64("text")), *keep).select(*keep, F.explode(F.array("template", "plain")).alias("x"))
    d = window_hashes(d, "x", lengths, *keep)
    hashes = grams.select("h").distinct()
    if not small:
        every = F.flatten(F.array(*[F.transform(f"g{n}", lambda h, i: F.struct(i.alias("at"), h.alias("h"))) for n in lengths]))
        return d.select(*keep, F.inline(every)).join(hashes, "h", "left_semi").select(*keep, "at", "h").distinct()
    # The map is a query's value, not a literal: each text of a plan spells literals out, and the driver makes many.
    known = _byte_map([r["h"] for r in hashes.collect()])
    held = docs.sparkSession.createDataFrame(pa.table({"known": pa.array([known], pa.binary())})).scalar()
    likely = lambda m, h: F.substring(m, (h.bitwiseAND(len(known) - 1) + 1).cast("int"), F.lit(1)) == F.lit(b"\x01")
    marked = lambda m, n: F.filter(F.transform(f"g{n}", lambda h, i: F.when(likely(m, h), F.struct(i.alias("at"), h.alias("h")))), lambda x: x.isNotNull())
    # Named once, so that it becomes part of the expression and no row carries it; the generator's input is not a bare column, of which a filter would repeat all hashing.
    found = F.transform(F.array("_known"), lambda m: F.flatten(F.array(*[marked(m, n) for n in lengths])))
    d = d.withColumn("_known", held).select(*keep, found.alias("_found"))
    return d.select(*keep, F.inline(F.flatten("_found"))).join(F.broadcast(hashes), "h", "left_semi").select(*keep, "at", "h").distinct()


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    window: int = 8,
    short: int = 5,
    coverage: float = 0.5,
    drift: int = 4,
    broadcast_rows: int = 100_000,
) -> DataFrame:
    """doc_id, item_id, windows, item_windows, n_slots: a document and the template class (by its smallest item) that it holds."""
    docs = docs.select("doc_id", "text")
    items = stored(_items(benchmark, window, short), "classes")
    lengths = sorted(r["n"] for r in items.select("n").distinct().collect()) or [window]  # ``window`` of them at most
    grams = stored(_grams(items, lengths), "grams")
    small = grams.count() <= broadcast_rows
    side = F.broadcast if small else (lambda df: df)
    totals = grams.groupBy("class_id").agg(F.count_distinct("item_at").alias("item_windows"), F.count_distinct(F.when(F.col("own"), F.col("item_at"))).alias("own_windows"))

    met = stored(_met(docs, grams, lengths, small), "met")
    which = stored(met.select(F.col("doc_id").alias("_d"), F.col("_text").alias("_t")).distinct(), "which")
    texts = docs.withColumn("_text", F.xxhash64("text"))
    one = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_text") == F.col("_t"))
    texts = texts.join(F.broadcast(which) if which.count() <= FEW_DOCS else which, one, "left_semi")
    own = canonical(texts, "doc_id", "_text").select(F.col("doc_id").alias("_d"), F.col("_text").alias("_t"), "words")
    hits = met.join(own, one).join(side(grams), "h").select("doc_id", "class_id", "item_at", "own", (F.col("at") - F.col("item_at")).alias("shift"), "t", "s", F.slice("words", F.col("at") + 1, F.col("n")).alias("ws"))

    pairs = F.transform(F.sequence(F.lit(0), F.size("s") - 1), lambda k: F.struct(F.get("s", k).alias("i"), F.get("t", k).alias("t"), F.get("ws", k).alias("w")))
    pairs = F.transform(F.filter(pairs, lambda p: p["i"] > 0), lambda p: F.struct(p["i"].alias("i"), _slot_value(p["t"], p["w"]).alias("v")))
    # A document's matches stay together from here on: one shuffle.
    hits = hits.select("doc_id", "class_id", "shift", F.struct("item_at", "shift", "own", pairs.alias("pairs")).alias("m")).repartition("doc_id")
    lines = hits.groupBy("doc_id", "class_id", "shift").agg(F.collect_set("m").alias("ms"))
    beside = Window.partitionBy("doc_id", "class_id").orderBy("shift").rangeBetween(-drift, drift)
    lines = lines.withColumn("ms", F.flatten(F.collect_list("ms").over(beside)))
    places = lambda ms: F.size(F.array_distinct(F.transform(ms, lambda m: m["item_at"])))
    lines = lines.withColumn("windows", places(F.col("ms"))).withColumn("found", places(F.filter("ms", lambda m: m["own"]))).join(side(totals), "class_id")
    # Enough of all windows, or of those that the template can identify if they are not a mere few of all.
    lines = lines.filter(F.expr(f"windows >= {coverage} * item_windows or (found >= {coverage} * own_windows and found >= {coverage / 2} * item_windows)"))
    # Each place of the item takes the match nearest to the alignment's own diagonal.
    near = F.array_sort(F.transform("ms", lambda m: F.struct(m["item_at"].alias("at"), F.abs(m["shift"] - F.col("shift")).alias("off"), m["shift"].alias("shift"), m["pairs"].alias("pairs"))))
    chosen = _let(near, lambda a: F.filter(a, lambda m, i: (i == 0) | (F.get(a, i - 1)["at"] != m["at"])))
    lines = lines.withColumn("slots", F.array_distinct(F.flatten(F.transform(chosen, lambda m: m["pairs"]))))
    lines = lines.filter(F.size(F.array_distinct(F.transform("slots", lambda p: p["i"]))) == F.size("slots"))
    best = F.max_by(F.struct("windows", "item_windows", F.size("slots").alias("n_slots")), F.struct(F.col("windows"), -F.col("shift"))).alias("b")
    return lines.groupBy("doc_id", "class_id").agg(best).select("doc_id", F.col("class_id").alias("item_id"), "b.windows", "b.item_windows", "b.n_slots")
