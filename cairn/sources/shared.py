"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoints(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where none is set, a folder of this machine if all of Spark runs in one process here, else an error."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_dir:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='cairn-')}")
        set_dir = spark.sparkContext.getCheckpointDir()
    return set_dir


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoints(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
