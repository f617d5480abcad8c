"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_roots: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder is set, once, only where the session has none."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = f"file://{tempfile.mkdtemp(prefix='gridloom-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path for one table, deleted when the driver ends."""
    root = f"{shared_folder(spark)}/gridloom-cube-{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(_drop, spark, root)
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def _drop(spark: SparkSession, root: str) -> None:
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the gateway may be gone; the cluster clears the folder
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written and read again: lineage is cut, and files outlive any executor."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
