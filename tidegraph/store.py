"""Tables and files in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Schemes that Spark writes and the file systems of pyarrow know by another name. ``dbfs:`` is mounted.
ALIASES = {"s3a": "s3", "s3n": "s3"}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where the session names none, a fresh local folder on
    a single machine, and an error on a cluster, whose executors would not share it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir has to name a folder that driver and executors share (master {master})")
        found = "file://" + tempfile.mkdtemp(prefix="tidegraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut, and
    a lost executor costs only the tasks it was running. ``release`` deletes it."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` as a table bucketed by ``key``: later joins and groupings on ``key`` with
    as many partitions don't move its rows. ``release`` drops it."""
    spark = df.sparkSession
    n, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{name}_{uuid.uuid4().hex}"
    path = fresh_path(spark, name)
    df.repartition(n, key).write.bucketBy(n, key).option("path", path).saveAsTable(table)
    out = spark.table(table)
    out._written, out._table = path, table
    return out


def release(*frames: DataFrame) -> None:
    """Deletes the folders, and drops the tables, of frames that ``materialize`` or
    ``bucketed`` gave. Other frames are left alone."""
    for df in frames:
        spark = df.sparkSession
        if table := getattr(df, "_table", None):
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        if path := getattr(df, "_written", None):
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder of any store that Spark writes to."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def open_fs(uri: str):
    """(file system, path) by pyarrow, of a file or folder as Spark names it.

    Supported: paths without a scheme, ``file:``, ``hdfs:``, ``gs:``, ``abfs(s):``, ``s3:``, ``s3a:`` and
    ``s3n:`` (as ``s3:``), and ``dbfs:`` (as its mount under /dbfs).
    """
    from pyarrow import fs

    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        return fs.FileSystem.from_uri("file://" + uri)
    rest = "/" + rest.lstrip("/") if not rest.startswith("//") else rest
    if scheme in ("file", "dbfs"):
        path = "/" + rest.lstrip("/")
        return fs.FileSystem.from_uri("file://" + ("/dbfs" + path if scheme == "dbfs" else path))
    return fs.FileSystem.from_uri(f"{ALIASES.get(scheme, scheme)}:{rest}")
