"""Structured Streaming counterparts: incremental ingestion, windows, duplicates, gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scratch import new_path


def read_events(spark: SparkSession, sf_dir: str, files_per_trigger: int = 8) -> DataFrame:
    """The event log as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    path = f"{sf_dir}/event[s].parquet"  # a pattern: the table may be one file or a folder of files
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(events: DataFrame, key: str = "event_id", delay: str = "10 minutes") -> DataFrame:
    """The first of each key within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def hourly(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    w = events.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", (F.round("total", 4) + F.lit(0.0)).alias("total"))


def sessions(events: DataFrame, gap: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    s = events.withWatermark("ts", delay).groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("first_ts"), F.col("session_window.end").alias("last_ts"), "n")


def run_to_end(stream: DataFrame, spark: SparkSession) -> DataFrame:
    """Run a stream over all that its source has now and return the result table.

    ``complete`` output, so windows that the watermark has not closed are in it
    too; each batch replaces the table in the shared folder.
    """
    path = new_path(spark, "stream")
    spark.createDataFrame([], stream.schema).write.parquet(path)
    sink = stream.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path))
    sink.option("checkpointLocation", new_path(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
