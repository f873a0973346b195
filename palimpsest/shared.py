"""The folder that driver and executors share, and files in it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names. Only a session whose executors are threads of the driver
    (master ``local``) may leave it unset and gets a temporary folder; on a cluster each
    machine would write to a folder of its own, so there it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = f"file://{tempfile.mkdtemp(prefix='palimpsest-')}"
    return _local[app]


def file_system(spark: SparkSession, path: str):  # noqa: ANN201
    """(file system, path) as Hadoop objects."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder, if it exists."""
    fs, target = file_system(spark, path)
    fs.delete(target, True)


def unused(df: DataFrame, stem: str) -> str:
    """``stem``, with underscores before it until no column of ``df`` begins so."""
    while any(c.lower().startswith(stem.lower()) for c in df.columns):
        stem = f"_{stem}"
    return stem
