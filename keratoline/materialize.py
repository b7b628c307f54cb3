"""Intermediate results that several later steps read."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """The rows, computed once into the shared folder of spark.checkpoint.dir, so steps that branch don't repeat the work.

    Where that setting is empty, a folder of our own is used, but on a single machine only.
    """
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        told = spark.conf.get("spark.checkpoint.dir", None)
        if not told and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(told or os.path.join(tempfile.gettempdir(), "keratoline-checkpoints"))
    return df.checkpoint(eager=True)
