"""The space-time cube as DataFrames.

A cube is ordinary columns: ``cell_id`` (with ``row``, ``col`` on a lattice of
``WIDTH`` columns), ``year`` (the frame), a value and a weight. ``observations``
derives one from the star schema; the same derivation as SQL text is ``CTES``,
so every query has a twin in plain SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 25
DISTRICTS = 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell_id, row, col, district, built, elev, cls: the cell dimension."""
    p = table(spark, sf_dir, "part")
    c = F.col("p_partkey")
    return p.select(
        c.alias("cell_id"),
        F.floor(c / WIDTH).cast("long").alias("row"),
        (c % WIDTH).alias("col"),
        (F.floor(c / 8).cast("long") % DISTRICTS).alias("district"),
        (F.col("p_size") / 50.0).alias("built"),
        F.col("p_retailprice").alias("elev"),
        F.col("p_type").alias("cls"),
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell_id, year, v, w: several fine values of each cell and frame."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_partkey").alias("cell_id"),
        F.year("l_shipdate").cast("long").alias("year"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("v"),
        F.col("l_quantity").alias("w"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_discount").alias("x"),
        F.col("l_shipdate").alias("ts"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell_id, year, lst, w, n: the median composite of each cell and frame."""
    return pixels(spark, sf_dir).groupBy("cell_id", "year").agg(F.percentile("v", F.lit(0.5)).alias("lst"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"))


def annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scope, year, value: mean order price by nation and year."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    j = o.join(c, o["o_custkey"] == c["c_custkey"])
    return j.groupBy(F.col("c_nationkey").cast("long").alias("scope"), F.year("o_orderdate").cast("long").alias("year")).agg(F.avg("o_totalprice").alias("value"))


#: The same tables as SQL, to be put after WITH.
CTES = f"""
cells AS (
  SELECT p_partkey AS cell_id, p_partkey // {WIDTH} AS row, p_partkey % {WIDTH} AS col, (p_partkey // 8) % {DISTRICTS} AS district,
         p_size / 50.0::DOUBLE AS built, p_retailprice AS elev, p_type AS cls FROM part
), pixels AS (
  SELECT l_partkey AS cell_id, CAST(year(l_shipdate) AS BIGINT) AS year, l_extendedprice / l_quantity AS v, l_quantity AS w,
         l_returnflag AS flag, l_discount AS x, l_shipdate AS ts FROM lineitem
), obs AS (
  SELECT cell_id, year, quantile_cont(v, 0.5) AS lst, sum(w) AS w, count(*) AS n FROM pixels GROUP BY ALL
), annual AS (
  SELECT CAST(c_nationkey AS BIGINT) AS scope, CAST(year(o_orderdate) AS BIGINT) AS year, avg(o_totalprice) AS value
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL
)"""
