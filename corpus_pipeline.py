"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, mixing.

Each stage works on all that its predecessor kept and returns the columns of
``documents``; the last adds the mix's. Stages are written as Parquet and read
again, so a lost executor costs at most one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, linededup, mixing, nearcopies, toxicity
from gridloom.llm.common import WORD, stored, table

#: Near copies: Jaccard similarity of five-word shingles.
SHINGLE, SIMILARITY = 5, "0.8"


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model predicts as toxic go; null and empty texts are judged like any other."""
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"), keep=True)
    return scored.filter("predicted = 0").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from all but one document; a document that they leave without a word goes too. One without a word before stays."""
    out = linededup.dedup_lines(docs)
    out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.filter((F.col("n_dropped") == 0) | F.col("text").rlike(WORD)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest doc_id stays. Rows with a null doc_id stay.

    Of the rows of a repeated doc_id the smallest one, by all columns in turn with the text first, stands for all.
    """
    docs_of = docs.filter("doc_id is not null")
    if not docs_of.groupBy("doc_id").count().filter("count > 1").isEmpty():
        order = ["text", *[c for c in docs.columns if c != "text"]]
        docs_of = stored(docs_of.groupBy("doc_id").agg(F.min(F.struct(*order)).alias("_row")).select(*[F.col(f"_row.{c}") for c in docs.columns]), "unique")
    groups = nearcopies.near_copies(docs_of, words=SHINGLE, similarity=SIMILARITY)
    keep = groups.filter("doc_id = component_id").select(F.col("doc_id").alias("_id"))
    kept = docs_of.join(keep, F.col("doc_id") == F.col("_id"), "left_semi")
    return kept.union(docs.filter("doc_id is null")).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Rows with a null doc_id are judged by their own text."""
    key = F.when(F.col("doc_id").isNull(), F.concat(F.lit("t"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))).otherwise(F.concat(F.lit("i"), F.col("doc_id").cast("string")))
    keyed = docs.select(key.alias("doc_id"), "text")
    leaks = decontaminate.find_leaks(keyed, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(leaks, key == F.col("_id"), "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the number of its words that the mix takes."""
    return mixing.mix_sources(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix),
]
#: No stage but the second and the last has an SQL form; the whole is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
