"""The folder that all executors share, and what is kept there."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a folder of our own in local mode; on a cluster no folder is shared, so it is an error."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (known or tempfile.mkdtemp(prefix="spark-", dir="/tmp")).rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()
