"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only in a local session without one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.graphloom.scratch", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.graphloom.scratch", root)
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write once as Parquet and read back: cuts lineage, survives lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
