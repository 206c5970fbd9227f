"""Stored objects by prefix, through the file system that the path names (local, HDFS, object stores)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _system(spark: SparkSession, path: str):
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own, own.getFileSystem(spark._jsc.hadoopConfiguration())


def listed(spark: SparkSession, folder: str, prefix: str = "") -> DataFrame:
    """(path, modified, size) of the files below a folder whose name begins with the prefix. Hidden files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size")).where(name.startswith(prefix))


def exists(spark: SparkSession, path: str) -> bool:
    own, system = _system(spark, path)
    return bool(system.exists(own))


def get(spark: SparkSession, folder: str, prefix: str = "") -> DataFrame:
    """(path, data) of the files below a folder whose name begins with the prefix."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.where(F.element_at(F.split("path", "/"), -1).startswith(prefix)).select("path", F.col("content").alias("data"))


def remove(spark: SparkSession, paths: list[str]) -> int:
    """Deletes files; returns how many there were. Those already gone are no error."""
    gone = 0
    for path in paths:
        own, system = _system(spark, path)
        gone += bool(system.delete(own, False))
    return gone


def remove_older(spark: SparkSession, folder: str, as_of: str, days: int) -> int:
    """Export retention: deletes files that were last written more than `days` before as_of. What a folder lists is names,
    so it is walked on the driver."""
    old = listed(spark, folder).where(F.col("modified") < F.lit(as_of).cast("timestamp") - F.make_dt_interval(days=F.lit(days)))
    return remove(spark, [r.path for r in old.select("path").toLocalIterator()])
