"""Intermediate results that later steps read more than once."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share. One is made only where they are one process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="ndspark-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def staged(rows: DataFrame) -> DataFrame:
    """Materialised once, in the shared folder, partitions and order kept."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint(eager=True)
