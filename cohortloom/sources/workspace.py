"""Folders that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession, tag: str) -> str:
    """The path of a folder of a new name below spark.checkpoint.dir; it isn't made yet.

    Where the session names no such folder, a local master gets one that goes with
    the driver; any other fails, as its machines write to disks of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and all executors of {master} share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            path = tempfile.mkdtemp(prefix="cohortloom-")
            atexit.register(shutil.rmtree, path, ignore_errors=True)
            _own[app] = f"file://{path}"
        root = _own[app]
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df, made once: read back from a new folder of the shared ones. For rows that a plan would otherwise make many times."""
    folder = shared_folder(df.sparkSession, tag)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
