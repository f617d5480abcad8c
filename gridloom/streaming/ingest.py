"""Keyed, resumable ingestion: a file stream into a table of the newest (or first) row of each key.

Every micro-batch reduces its rows to one for each key and writes them to the
folder that carries its number, replacing what an attempt cut short has left
there. The stream's checkpoint says which files a batch has, so a run that was
killed anywhere goes on with the same batches, and a file is never taken twice.
Reading picks one row for each key over all batches; both steps combine before
the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def one_of_each(df: DataFrame, keys: list[str], order: list[str], keep: str = "last") -> DataFrame:
    """The row of each key that is last (or first) by ``order``, then by all other columns; null keys are a key."""
    if keep not in ("first", "last"):
        raise ValueError("keep is first or last")
    rest = [c for c in df.columns if c not in order]
    rank: Column = F.struct(*[F.col(c) for c in (*order, *rest)])
    pick = F.max_by if keep == "last" else F.min_by
    return df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(pick(F.struct(*df.columns), rank).alias("_r")).select("_r.*")


def ingest(stream: DataFrame, keys: list[str], order: list[str], target: str, checkpoint: str, *, keep: str = "last", after: Callable[[int], None] | None = None) -> StreamingQuery:
    """Take all that the source has now into ``target``; start it again at any time with the same ``checkpoint``. ``after`` is called with the number of each written batch."""

    def save(df: DataFrame, batch: int) -> None:
        one_of_each(df, keys, order, keep).write.mode("overwrite").parquet(f"{target}/batch={batch}")
        if after:
            after(batch)

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested(spark: SparkSession, schema, keys: list[str], order: list[str], target: str, *, keep: str = "last") -> DataFrame:
    """The table as of the batches written so far."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(target)
    return one_of_each(rows, keys, order, keep)
