"""File-system questions asked through the session's Hadoop configuration."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _hadoop(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _hadoop(spark, path)
    return fs.exists(target)


def make_folder(spark: SparkSession, path: str) -> None:
    fs, target = _hadoop(spark, path)
    fs.mkdirs(target)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of the table that is about to be written anew."""
    fs, target = _hadoop(spark, path)
    fs.delete(target, True)


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over, too."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


def has_data_files(spark: SparkSession, path: str) -> bool:
    """Whether the folder holds, at any depth, a file that is neither marker nor hidden."""
    fs, target = _hadoop(spark, path)
    if not fs.exists(target):
        return False
    root = fs.makeQualified(target).toString()
    files = fs.listFiles(target, True)
    while files.hasNext():
        inside = files.next().getPath().toString()[len(root) :]
        if not any(_hidden(name) for name in inside.split("/")):
            return True
    return False
