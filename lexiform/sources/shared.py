"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folder of this process by application: made once, deleted when the session ends.
_ROOTS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Without one only a local session gets a folder of its own; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir names no folder; executors need one that they share")
    if "local" not in _ROOTS:
        _ROOTS["local"] = tempfile.mkdtemp(prefix="lexiform-")
        atexit.register(shutil.rmtree, _ROOTS["local"], ignore_errors=True)
    return "file://" + _ROOTS["local"]


def _path(spark: SparkSession, path: str):
    """The path and its file system, both of the JVM."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def work_dir(spark: SparkSession) -> str:
    """This application's own part of the shared folder; its file system deletes it when the application ends."""
    app = spark.sparkContext.applicationId
    root = f"{shared_dir(spark)}/lexiform-{app}"
    if _ROOTS.get(app) != root:
        at, fs = _path(spark, root)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _ROOTS[app] = root
    return root


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, by: list[str] | None = None, codec: str | None = None, one_row_files: bool = False) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, outlives executors. ``by``: columns that name its folders. one_row_files: large rows, a file each."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("maxRecordsPerFile", 1) if one_row_files else df.write
    (writer.partitionBy(*by) if by else writer).parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexiform_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what materialize() wrote for df; nothing may read it any more."""
    at, fs = _path(df.sparkSession, df._lexiform_path)
    fs.delete(at, True)
