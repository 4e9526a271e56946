"""Intermediate results on shared files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def _place(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, removed when the session's JVM ends. Where that is unset a local session gets a temporary folder; no other may."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
    path = f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"
    where, files = _place(spark, path)
    files.mkdirs(where)
    files.deleteOnExit(where)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Removes a folder of which nothing is read any more."""
    where, files = _place(spark, path)
    files.delete(where, True)


def settled(df: DataFrame) -> DataFrame:
    """The rows written and read again: a lineage that does not grow, and that outlives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled_with_count(df: DataFrame) -> tuple[DataFrame, int]:
    """settled(), and the number of rows, counted as they are written."""
    seen = Observation()
    out = settled(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, seen.get["n"]
