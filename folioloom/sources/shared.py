"""The folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoints(spark: SparkSession) -> None:
    """Keeps the folder that the session names in spark.checkpoint.dir; names one in the warehouse only where all runs in one process, else that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
    context.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")


def written(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder, so that what is read several times is worked out once."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint()
