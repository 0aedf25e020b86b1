"""Cutting the lineage of iterative plans with reliable checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """`df` computed and checkpointed in the folder that all executors share (spark.checkpoint.dir).

    A folder of this process is set only where none is set and the master is local, as in tests.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="factloom-")
        context.setCheckpointDir(folder)
    return df.checkpoint()
