"""Where intermediate tables go.

Lineage is cut by writing a table into the shared folder that the cluster names
in ``spark.checkpoint.dir``; such a table outlives any executor. Only a local
session without that setting (tests) gets a folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dir: str | None = None


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables."""
    global _local_dir
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="anualia-")
    return _local_dir


def new_path(spark: SparkSession, label: str) -> str:
    """A path nobody used before."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write the frame once and return the written table."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
