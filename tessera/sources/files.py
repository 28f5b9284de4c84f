"""Listing and preparing folders, on any file system that Spark reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROBE = ".touch"


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def read_dir(spark: SparkSession, path: str, ext: str | None = None) -> DataFrame:
    """``name`` of the entries of a folder in order, those with the extension (dot included) only if one is given."""
    fs, where = _at(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    kept = sorted(n for n in names if ext is None or ("." in n and n[n.rindex(".") :] == ext))
    return spark.createDataFrame([(n,) for n in kept], "name string")


def files_of(spark: SparkSession, path: str, ext: str = "") -> DataFrame:
    """``path, length`` of the files of a folder, listed by the executors."""
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{ext}").load(path).select("path", F.col("length"))


def exist(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def is_dir_writeable(spark: SparkSession, path: str) -> bool:
    """Whether a file can be made in the folder; it is removed at once."""
    fs, where = _at(spark, f"{path}/{PROBE}")
    try:
        fs.create(where, True).close()
        return fs.delete(where, False)
    except Exception:  # any refusal of the file system, wrapped by Py4J
        return False


def touch_dir_all(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    if not fs.mkdirs(where) or not is_dir_writeable(spark, path):
        raise PermissionError(path)


def create_dir_all(spark: SparkSession, path: str) -> None:
    """As :func:`touch_dir_all`, but the folder must be empty."""
    touch_dir_all(spark, path)
    fs, where = _at(spark, path)
    if len(fs.listStatus(where)):
        raise FileExistsError(path)
