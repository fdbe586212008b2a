"""Folders on the file system that Spark reads: listing, and renames that never replace anything."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _located(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, files = _located(spark, path)
    return files.exists(at)


def numbered(spark: SparkSession, folder: str, prefix: str = "", marker: str | None = None) -> list[int]:
    """The numbers N of the entries ``<prefix>N`` of a folder, rising; with a marker only those that hold that file."""
    at, files = _located(spark, folder)
    if not files.exists(at):
        return []
    names = [s.getPath().getName() for s in files.listStatus(at)]
    found = sorted(int(n[len(prefix):]) for n in names if n.startswith(prefix) and n[len(prefix):].isdigit())
    return [n for n in found if marker is None or exists(spark, f"{folder}/{prefix}{n}/{marker}")]


def incoming(folder: str) -> str:
    """A fresh path in the folder for something half written; readers pass over it."""
    return f"{folder}/_incoming-{uuid.uuid4().hex}"


def claim(spark: SparkSession, source: str, target: str) -> bool:
    """Rename in one step; False, and nothing changed, if the target is there already."""
    fs = spark._jvm.org.apache.hadoop.fs
    rename = getattr(fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.NONE
    if exists(spark, target):
        return False
    at, files = _located(spark, target)
    files.mkdirs(at.getParent())
    context = fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration()) if at.toUri().getScheme() \
        else fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    try:
        context.rename(fs.Path(source), at, how)
    except Py4JJavaError:
        if exists(spark, target):
            return False
        raise
    return True


def remove(spark: SparkSession, path: str) -> None:
    at, files = _located(spark, path)
    files.delete(at, True)
