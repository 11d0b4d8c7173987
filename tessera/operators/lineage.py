"""Where a plan ends: rows that many later steps read are computed once."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder spark.checkpoint.dir that driver and executors share. A session on one machine without that setting gets one of its own; on a cluster it is an error."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="tessera-"))
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """df, computed once into the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
