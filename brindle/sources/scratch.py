"""Frames written to the folder that driver and executors share, to cut a lineage or to read them twice."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local one only where none is named and all runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
    made = f"/tmp/checkpoints/{uuid.uuid4().hex}"
    spark.sparkContext.setCheckpointDir(made)
    return f"file://{made}"


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; what is there goes when this process ends."""
    path = f"{shared_dir(spark)}/brindle-{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session has ended already
        return


def kept(df: DataFrame) -> DataFrame:
    """`df` written and read again."""
    path = fresh_dir(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
