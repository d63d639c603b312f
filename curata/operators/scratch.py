"""Cutting lineage between rounds of iterative operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return at or tempfile.mkdtemp(prefix="curata-")


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder, so that later rounds start from files that outlive lost executors."""
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint()
