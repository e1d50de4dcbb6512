"""Tables that cut a lineage, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only where Spark runs in this process alone a temporary one is set instead."""
    context = spark.sparkContext
    path = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not re.match(r"local($|\[)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="sondeframe-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(path)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there, so that rounds neither repeat what came before nor lose it with an executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
