"""Tables that an operator writes between its steps, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` as the session has it, or a temporary folder where it is unset and all runs on one machine."""
    found = spark.sparkContext.getCheckpointDir()
    if found is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if found is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            found = tempfile.mkdtemp(prefix="shared-")
            atexit.register(shutil.rmtree, found, True)
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _remove_made() -> None:
    for spark, path in _MADE:
        with contextlib.suppress(Exception):  # the session may be gone
            remove(spark, path)


def new_path(spark: SparkSession, name: str = "table") -> str:
    """A fresh path in the shared folder; what is written there goes when the process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """The same rows as a Parquet table; for tables that grow with the input."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept; for small tables that several jobs or rounds read. They are removed with the others, which checkpoint files are not."""
    return written(df, "cut")
