"""Cutting lineage in loops; the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}  # by application


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where none is set (one machine) a new temporary one."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        folder = _own[app] = _own.get(app) or tempfile.mkdtemp(prefix="spark-folium-", dir="/tmp")
    return folder.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the session's checkpoint folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
