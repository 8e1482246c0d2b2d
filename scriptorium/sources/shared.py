"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that the cluster shares; only local sessions may go without one and get a temporary one."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        where = context.getConf().get("spark.checkpoint.dir", None)
        if not where and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(where or "file://" + tempfile.mkdtemp(prefix="scriptorium-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    folder(df.sparkSession)
    return df.checkpoint()
