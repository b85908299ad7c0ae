"""Folders and files of any file system Spark can read."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly below a path; none if it does not exist."""
    fs, where = _at(spark, path)
    if not fs.exists(where):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory())


def files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(full path, bytes) of the files at or directly below a path, by name; hidden ones are left out."""
    fs, where = _at(spark, path)
    found = [s for s in fs.listStatus(where) if s.isFile() and s.getPath().getName()[0] not in "_."]
    return sorted((s.getPath().toString(), s.getLen()) for s in found)


def has_file(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file, or a folder with all in it."""
    fs, where = _at(spark, path)
    fs.delete(where, True)
