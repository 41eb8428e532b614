"""Shared folders, written intermediate tables and file access for the operators.

Intermediate tables are written, never kept in executors: a lost executor costs
a re-read of files in the shared folder and nothing else.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side with at most this many rows of a few longs is broadcast; beyond, joins shuffle.
BROADCAST_ROWS = 100_000


_own: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where the
    cluster names one; else, with a local master only, a folder of this application's
    own, which goes when the driver ends. On a cluster without one this fails: each
    machine would write to a disk of its own."""
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
    return root.rstrip("/")


def work_folder(spark: SparkSession, tag: str) -> str:
    """A fresh folder below the shared root. Its file system deletes what is left of it when the application ends."""
    path = f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"
    fs, at = _hadoop(spark, path)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def _hadoop(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def delete_folder(spark: SparkSession, path: str) -> None:
    fs, at = _hadoop(spark, path)
    fs.delete(at, True)


def written(df: DataFrame, folder: str, name: str, codec: str = "zstd") -> DataFrame:
    """df as a Parquet table in the folder, read back: cuts the lineage."""
    path = f"{folder}/{name}"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, folder: str, tag: str) -> DataFrame:
    """df, written to a folder of its own; the folder of what it was made from is deleted."""
    out = written(df, work_folder(df.sparkSession, tag), "result")
    delete_folder(df.sparkSession, folder)
    return out


def open_fs(uri: str):
    """(file system, path) for a shared-folder URI, in a Python worker or the driver."""
    from pyarrow import fs

    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[len("file:"):]
    if uri.startswith("/"):
        uri = "file://" + uri
    return fs.FileSystem.from_uri(uri)


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, a written table or another that is cheap to count, marked for broadcast if it has no more rows than that."""
    return F.broadcast(df) if df.count() <= rows else df


def at_most(df: DataFrame, rows: int, by: str) -> DataFrame:
    """At most `rows` rows of df for each value of `by`, chosen by a hash of all columns; each task hands on no more than that."""
    place = fresh("place", df)
    order = Window.partitionBy(by).orderBy(F.xxhash64(*df.columns, F.lit(17)), *df.columns)
    return df.withColumn(place, F.row_number().over(order)).where(F.col(place) <= rows).drop(place)


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name near `name` that none of the frames has, whatever the case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def only(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and text alone, under those names: other columns can't clash."""
    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
