"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word is a run of anything but the six ASCII whitespace bytes.
WORD = r"[^\x20\x09-\x0D]+"
_scratch: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; other alphabets keep their case."""
    return F.translate(c, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session has none (local tests) a temporary folder is set,
    once, in the session.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = f"file://{tempfile.mkdtemp(prefix='gridloom-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, deleted when the driver ends."""
    root = f"{shared_dir(spark)}/gridloom-{spark.sparkContext.applicationId}"
    if root not in _scratch:
        _scratch.add(root)
        atexit.register(drop_scratch, spark, root)
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def drop_scratch(spark: SparkSession, root: str) -> None:
    """Delete a scratch folder; a gateway that is already gone leaves it to the cluster's own clean-up."""
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the driver is ending
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage like ``checkpoint()``, but column-wise and compressed; the
    files outlive any executor.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
