"""What a folder of tables needs from its file system, in any that Spark can read."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, root: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def matching(spark: SparkSession, pattern: str) -> list[str]:
    fs, path = _fs(spark, pattern)
    return sorted(f.getPath().toString() for f in fs.globStatus(path(pattern)) or [])


def drop(spark: SparkSession, name: str) -> bool:
    fs, path = _fs(spark, name)
    return bool(fs.delete(path(name), True))


def newest(spark: SparkSession, root: str) -> int | None:
    """The highest complete version of a folder of folders v=<number>."""
    found = matching(spark, f"{root}/v=*/_SUCCESS")
    return max((int(p.rsplit("/", 2)[1].removeprefix("v=")) for p in found), default=None)
