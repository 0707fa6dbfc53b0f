"""Paths in any store that Spark reaches: existence, renaming, deleting, and folders for queries that write."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _path(spark, path)
    return bool(fs.exists(where))


def files_below(spark: SparkSession, path: str, pattern: str = "") -> list[str]:
    """The files below a folder whose path holds the pattern: names only, nothing is read."""
    fs, where = _path(spark, path)
    out, found = [], fs.listFiles(where, True) if fs.exists(where) else None
    while found is not None and found.hasNext():
        name = found.next().getPath().toString()
        if re.search(pattern, name):
            out.append(name)
    return sorted(out)


def rename(spark: SparkSession, old: str, new: str) -> None:
    fs, source = _path(spark, old)
    target = _path(spark, new)[1]
    fs.mkdirs(target.getParent())
    fs.delete(target, True)
    if not fs.rename(source, target):
        raise OSError(f"cannot rename {old} to {new}")


def delete(spark: SparkSession, path: str) -> bool:
    fs, where = _path(spark, path)
    return bool(fs.delete(where, True))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the one that driver and executors share (spark.checkpoint.dir), dropped with the application.

    Only a local session without that setting gets a temporary folder of its machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="cograph-")
        spark.conf.set("spark.checkpoint.dir", shared)
    path = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    fs, where = _path(spark, path)
    fs.deleteOnExit(where)
    return path
