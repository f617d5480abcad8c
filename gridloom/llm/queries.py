"""One query for each operator, over whole tables with production parameters, and its DuckDB twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, lexical, linededup, lm, mixing, negatives, packing, secrets, simhash, substrings, toxicity, urlfilter
from .common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.kneser_ney_scores(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op6_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the quality label that carries its number."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), outcomes).select("page_id", "host", "path", "rule", "verdict")


def op7_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh row has a wrong label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine_hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    first = (op1_simhash, op2_ann, op3_toxicity, op4_lm, op5_mixing, op6_urlfilter, op7_linededup, op8_secrets, op9_substrings, op10_decontaminate)
    return {f.__name__: f for f in (*first, op11_hard_negatives, op12_packing, op13_lexical)}


#: Lower-casing of A-Z alone, as SQL text.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP7 = f"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS nth, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents
), keyed AS (
  SELECT *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM lines
), often AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.doc_id, k.nth, k.line, (o.key IS NOT NULL AND k.doc_id <> o.keeper) AS gone FROM keyed k LEFT JOIN often o ON k.key = o.key
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP6 = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*', 0)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), fits AS (
  SELECT p.page_id, r.action, r.host || r.path AS rule,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC) AS nth
  FROM p JOIN (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('allow', 'example.net', '/de/8'), ('block', 'org', '/es/')) r(action, host, path)
    ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
), hosts AS (
  SELECT host, count(q.quality)::DOUBLE AS n, coalesce(sum(1 - q.quality), 0)::DOUBLE AS bad,
         string_split(host, '.') AS parts
  FROM p LEFT JOIN labels q ON q.doc_id = p.page_id GROUP BY host
), named AS (
  SELECT host, n, bad, array_to_string(parts[-1:], '.') AS suffix, array_to_string(parts[-2:], '.') AS domain FROM hosts
), suf AS (
  SELECT suffix, sum(n) AS n, sum(bad) AS bad, CASE WHEN sum(sum(n)) OVER () > 0 THEN sum(sum(bad)) OVER () / sum(sum(n)) OVER () ELSE 0 END AS prior FROM named GROUP BY suffix
), sufs AS (
  SELECT s.*, m.k FROM suf s, (SELECT {{strength}} AS k FROM suf WHERE n > 0) m
), dom AS (
  SELECT d.suffix, d.domain, d.n, d.bad, (s.k * s.prior + s.bad) / (s.k + s.n) AS prior
  FROM (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM named GROUP BY ALL) d JOIN sufs s USING (suffix)
), doms AS (
  SELECT d.*, m.k FROM dom d, (SELECT {{strength}} AS k FROM dom WHERE n > 0) m
), hst AS (
  SELECT h.host, h.n, h.bad, (d.k * d.prior + d.bad) / (d.k + d.n) AS prior FROM named h JOIN doms d USING (domain)
), post AS (
  SELECT host, m.k * prior + bad AS a, m.k * (1 - prior) + n - bad AS b FROM hst, (SELECT {{strength}} AS k FROM hst WHERE n > 0) m
), low AS (
  SELECT host, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS low FROM post
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.action, CASE WHEN l.low > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fits f ON f.page_id = p.page_id AND f.nth = 1 LEFT JOIN low l ON l.host = p.host
""".replace(
    "{strength}",
    "coalesce(least(greatest(sum(n * prior * (1 - prior)) / sum(n) / greatest((sum((bad - n * prior) * (bad - n * prior) / n) - sum(prior * (1 - prior))) / sum(n), 1e-9) - 1, 2.0), 1000.0), 1000.0)",
)


OP11 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_dot_product(a.q, r.q) AS BIGINT) AS score
  FROM v a JOIN v r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""

_TERMS = f"unnest(regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))"
OP13 = f"""
WITH tf AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {_TERMS} AS term FROM documents) GROUP BY ALL
), len AS (
  SELECT doc_id, CAST(sum(tf) AS BIGINT) AS terms FROM tf GROUP BY doc_id
), whole AS (
  SELECT count(*) AS docs, CAST(sum(terms) AS BIGINT) AS total FROM len
), df AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, whole GROUP BY term
), norm AS (
  SELECT doc_id, 100 - 50 + (50 * terms * docs) // total AS m FROM len, whole
), asked AS (
  SELECT DISTINCT item_id, {_TERMS} AS term FROM benchmark
), scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN df USING (term) JOIN norm USING (doc_id) GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_hard_negatives": OP11, "op13_lexical": OP13, "op5_mixing": mixing.ORACLE, "op6_urlfilter": OP6, "op7_linededup": OP7}
