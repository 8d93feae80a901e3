"""Folders that the driver and all executors share, for what is written in passing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below spark.checkpoint.dir; Spark makes it, and removes it when the driver ends.

    A session on one machine without that setting, as in tests, gets one of its own. A cluster has to have the setting.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir")
    if not base:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="webloom-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        return f"{base}/{name}"
    path = context._jvm.org.apache.hadoop.fs.Path(f"{base}/webloom-{name}-{uuid.uuid4().hex}")
    path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()
