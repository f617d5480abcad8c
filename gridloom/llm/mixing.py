"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Everything here is DataFrame expressions. The corpus is read twice: once for
word counts (kept as id, source, size in the shared folder), and that small
table once for totals and once for the draw.

Plan of the draw
----------------
* a source is cut into shards of about ``shard_tokens`` words by a seeded hash
  of the document id, so no window ever holds a whole source;
* inside a shard, documents lie end to end in seeded order and are cut into
  blocks of ``block_tokens`` words;
* Sainte-Lague hands the mix's blocks to sources by their targets, then each
  source's blocks to its shards by shard size: integer quotas;
* a shard with quota q and b blocks takes every block q div b times, and
  q mod b further blocks along a seeded permutation.

Defined results: a null text has size 0 and takes 0; a null source is a source
of its own, last in order; an empty table gives an empty result; rows with a
repeated id are separate documents; an id of null hashes like -1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored

PRIME = 2147483647
STRIDE = 2147483629  # prime, so coprime to any number of blocks below it


def _hash(c: str, seed: int) -> str:
    """SQL text: a seeded Lehmer hash of a long; the same in any SQL engine."""
    return f"((((({c}) % {PRIME} + {PRIME}) % {PRIME} * 48271 + {seed}) % {PRIME}) * 69621 + {seed} * 7 + 11) % {PRIME}"


def targets(sources: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """``source, source_size`` -> plus ``rank, weight, target``.

    Targets share the total by weight, none above ``cap`` times its source: in
    order of cap/weight the first k sources are full and the rest share what is
    left, which is where resharing the excess ends up.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    filled = Window.orderBy("ratio", "rank")
    w = F.array(*[F.lit(float(x)) for x in weights])
    t = (
        sources.withColumn("rank", F.row_number().over(order).cast("long"))
        .withColumn("weight", F.element_at(w, ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
        .withColumn("ceiling", F.lit(float(cap)) * F.col("source_size"))
        .withColumn("ratio", F.col("ceiling") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("full", F.coalesce(F.sum("ceiling").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
        .withColumn("x", F.min_by("level", F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank"))).over(Window.partitionBy()))
    )
    return t.select("source", "source_size", "rank", "weight", "total", F.least(F.col("ceiling"), F.col("weight") * F.col("x")).alias("target"))


def sainte_lague(cells: DataFrame, group: list[str], key: str, votes: str, seats: str) -> DataFrame:
    """Add ``quota``: the seats of ``cells[seats]`` (one number per group) by highest quotients votes/(2k-1).

    With m cells, V votes and S seats, a cell ends within votes/V*(S -+ m/2) -+
    1/2 seats; only quotients in that range are made (about 2m in all), so the
    work does not depend on the number of seats.
    """
    g = Window.partitionBy(*group)
    share = F.col(votes) / F.col("_v")
    c = (
        cells.withColumn("_v", F.sum(votes).over(g))
        .withColumn("_m", F.count(F.lit(1)).over(g))
        .withColumn("_lo", F.when(F.col("_v") > 0, F.greatest(F.lit(0), F.floor(share * (F.col(seats) - F.col("_m") / 2) - 0.5))).otherwise(0).cast("long"))
        .withColumn("_hi", F.when(F.col("_v") > 0, F.floor(share * (F.col(seats) + F.col("_m") / 2) + 1.5)).otherwise(0).cast("long"))
        .withColumn("_left", F.col(seats) - F.sum("_lo").over(g))
    )
    ranked = (
        c.withColumn("_k", F.explode_outer(F.when(F.col("_hi") > F.col("_lo"), F.sequence(F.col("_lo") + 1, F.col("_hi")))))
        .withColumn("_q", F.col(votes) / (2 * F.col("_k") - 1))
        .withColumn("_r", F.row_number().over(g.orderBy(F.col("_q").desc_nulls_last(), F.col(key), F.col("_k"))))
    )
    won = F.sum(F.when(F.col("_k").isNotNull() & (F.col("_r") <= F.col("_left")), 1).otherwise(0))
    return ranked.groupBy(*cells.columns, "_lo").agg(won.alias("_won")).withColumn("quota", F.col("_lo") + F.col("_won")).drop("_lo", "_won")


def mix_sources(
    docs: DataFrame,
    *,
    weights: tuple[float, ...] = (1, 2, 3),
    cap: int = 3,
    block_tokens: int = 64,
    shard_tokens: int = 1 << 20,
    seed: int = 17,
) -> DataFrame:
    """doc_id, size, source_size, target, taken, source: words the mix takes of each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = stored(docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size")), "sizes")
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    sources = sainte_lague(sources.withColumn("seats", F.round(F.col("total") / block_tokens).cast("long")), [], "rank", "target", "seats")
    sources = stored(sources.select("source", "rank", "source_size", "target", F.col("quota").alias("source_quota"), F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_tokens)).cast("long").alias("shards")), "targets")
    # One row per source; its size is that of the source catalogue, so Spark itself decides on broadcasting.
    placed = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    placed = placed.withColumn("h", F.expr(_hash("coalesce(doc_id, -1)", seed))).withColumn("shard", F.col("h") % F.col("shards"))
    cells = placed.groupBy("rank", "shard", "source_quota").agg(F.sum("size").alias("cell_size"))
    cells = sainte_lague(cells, ["rank", "source_quota"], "shard", "cell_size", "source_quota")
    blocks = F.ceil(F.col("cell_size") / block_tokens).cast("long")
    cells = cells.select(
        F.col("rank").alias("c_rank"),
        F.col("shard").alias("c_shard"),
        blocks.alias("blocks"),
        F.least("quota", cap * blocks).alias("quota"),
        F.expr(_hash("rank * 1000003 + shard", seed + 1)).alias("offset"),
    )
    lie = Window.partitionBy("rank", "shard").orderBy(F.expr(_hash("h", seed + 2)), "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    drawn = placed.withColumn("stop", F.sum("size").over(lie)).withColumn("start", F.col("stop") - F.col("size"))
    drawn = drawn.join(cells, (F.col("rank") == F.col("c_rank")) & (F.col("shard") == F.col("c_shard")))
    # Whole blocks inside the document and its two ragged ends, as a short list; no window over blocks.
    first, last = F.expr(f"start div {block_tokens}"), F.expr(f"(stop - 1) div {block_tokens}")
    overlap = f"(least(stop, (j + 1) * {block_tokens}) - greatest(start, j * {block_tokens}))"
    copies = f"(quota div blocks + if((j * {STRIDE} + offset) % blocks < quota % blocks, 1, 0))"
    drawn = drawn.withColumn("js", F.when(F.col("size") > 0, F.sequence(first, last)))
    taken = F.when(F.col("size") > 0, F.expr(f"aggregate(js, 0L, (s, j) -> s + {overlap} * {copies})")).otherwise(F.lit(0).cast("long"))
    return drawn.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source")


ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), src AS (
  SELECT *, 3.0::DOUBLE * source_size AS ceiling, 3.0::DOUBLE * source_size / weight AS ratio, sum(source_size) OVER () AS total FROM (
    SELECT source, source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank,
           ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight
    FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source))
), lev AS (
  SELECT *, (total - coalesce(sum(ceiling) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM src
), tgt AS (
  SELECT source, rank, source_size, least(ceiling, weight * (SELECT level FROM lev WHERE level <= ratio ORDER BY ratio, rank LIMIT 1)) AS target,
         CAST(floor(total::DOUBLE / 64 + 0.5) AS BIGINT) AS seats, greatest(1, CAST(ceil(source_size / 1048576.0) AS BIGINT)) AS shards FROM lev
), quo AS (
  SELECT rank, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, rank, k) AS r, seats
  FROM tgt, generate_series(1, seats) AS s(k)
), quota AS (SELECT rank, count(*) AS source_quota FROM quo WHERE r <= seats GROUP BY rank
), placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.rank, coalesce(q.source_quota, 0) AS source_quota, d.source,
         {_hash('coalesce(doc_id, -1)', 17)} AS h, ({_hash('coalesce(doc_id, -1)', 17)}) % t.shards AS shard
  FROM sized d JOIN tgt t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN quota q ON q.rank = t.rank
), cell AS (
  SELECT rank, shard, source_quota, sum(size)::BIGINT AS cell_size FROM placed GROUP BY ALL
), cquo AS (
  SELECT rank, shard, source_quota, row_number() OVER (PARTITION BY rank ORDER BY cell_size::DOUBLE / (2 * k - 1) DESC, shard, k) AS r
  FROM (SELECT *, unnest(range(1, source_quota + 1)) AS k FROM cell WHERE cell_size > 0)
), cells AS (
  SELECT c.rank, c.shard, CAST(ceil(c.cell_size / 64.0) AS BIGINT) AS blocks,
         least(count(q.r), 3 * CAST(ceil(c.cell_size / 64.0) AS BIGINT)) AS quota,
         {_hash('c.rank * 1000003 + c.shard', 18)} AS off
  FROM cell c LEFT JOIN cquo q ON q.rank = c.rank AND q.shard = c.shard AND q.r <= q.source_quota GROUP BY c.rank, c.shard, c.cell_size
), lain AS (
  SELECT *, sum(size) OVER (PARTITION BY rank, shard ORDER BY {_hash('h', 19)}, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS stop FROM placed
), bits AS (
  SELECT l.*, l.stop - l.size AS start, c.blocks, c.quota, c.off FROM lain l JOIN cells c ON l.rank = c.rank AND l.shard = c.shard
)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN size = 0 THEN 0 ELSE list_sum(list_transform(range(start // 64, (stop - 1) // 64 + 1),
         lambda j: (least(stop, (j + 1) * 64) - greatest(start, j * 64))
                   * (quota // blocks + CASE WHEN (j * {STRIDE} + off) % blocks < quota % blocks THEN 1 ELSE 0 END))) END AS BIGINT) AS taken,
       source
FROM bits
"""
