"""Cutting the lineage of frames that a loop builds on."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session; where none is set, in local mode only (tests), a temporary one that goes at the end."""
    if (told := spark.conf.get("spark.checkpoint.dir", None)) is not None:
        return told
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint: a lost executor costs a read, and plans of later rounds stay small."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
