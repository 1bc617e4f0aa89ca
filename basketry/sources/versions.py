"""Numbered versions of a table folder: a version counts once it is marked complete."""

from __future__ import annotations

from pyspark.sql import SparkSession

DONE = "_SUCCESS"


def fs_of(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath, hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, as processes that do not ask Spark have to read it."""
    hpath, fs = fs_of(spark, path)
    return fs.makeQualified(hpath).toString()


def exists(spark: SparkSession, path: str) -> bool:
    hpath, fs = fs_of(spark, path)
    return fs.exists(hpath)


def versions(spark: SparkSession, root: str, complete: bool = True) -> list[int]:
    """Numbers of the complete versions, or of all."""
    hroot, fs = fs_of(spark, root)
    if not fs.exists(hroot):
        return []
    found = []
    for status in fs.listStatus(hroot):
        name = status.getPath().getName()
        if name.startswith("v=") and (not complete or exists(spark, f"{root}/{name}/{DONE}")):
            found.append(int(name[2:]))
    return sorted(found)


def next_version(spark: SparkSession, root: str) -> int:
    return max(versions(spark, root, complete=False), default=0) + 1
