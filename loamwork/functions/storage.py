"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's own folder below spark.checkpoint.dir, or, in a local session that has none, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}"
    return f"{root.rstrip('/')}/loamwork-{spark.sparkContext.applicationId}"


def staged(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors, computes once.

    compression is the session's unless it is given.
    Results are read lazily, so tables stay until clear_staged(), or else until the session's JVM ends.
    """
    spark = df.sparkSession
    root = shared_dir(spark)
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    _folder(spark, root)[1].deleteOnExit(_folder(spark, root)[0])
    return spark.read.schema(df.schema).parquet(path)


def clear_staged(spark: SparkSession) -> None:
    """Delete the session's intermediate tables. Frames that were made from them can't be read any more."""
    path, system = _folder(spark, shared_dir(spark))
    system.delete(path, True)


def _folder(spark: SparkSession, root: str) -> tuple:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())
