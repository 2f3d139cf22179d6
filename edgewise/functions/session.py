"""Session helpers: shared checkpoints, importable workers, bounded Arrow batches."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers and bound the Arrow batches they get.

    Settings that the caller has made are left alone.
    """
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode only."""
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if shared is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="edgewise-"))
    return shared or context.getCheckpointDir()


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder in whatever store it is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(frame: DataFrame) -> DataFrame:
    """Write ``frame`` to the shared checkpoint folder and go on from there."""
    checkpoint_dir(frame.sparkSession)
    return frame.checkpoint()
