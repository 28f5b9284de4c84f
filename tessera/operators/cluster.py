"""What a cluster offers in place of locks and threads: barriers, permits, deadlines, one session, logs."""

from __future__ import annotations

import logging
import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession


def in_step(df: DataFrame, parties: int, before: Callable, after: Callable) -> list:
    """Runs ``before`` on each of ``parties`` partitions, waits until all have ended it, then runs ``after``. The cluster needs as many free slots."""

    def task(rows):
        context = BarrierTaskContext.get()
        held = before(rows)
        context.barrier()
        return iter([after(context.partitionId(), held)])

    return df.rdd.repartition(parties).barrier().mapPartitions(task).collect()


class Permits:
    """At most n actions at a time."""

    def __init__(self, n: int):
        if n < 1:
            raise ValueError("n must be positive")
        self.pool = ThreadPoolExecutor(n)

    def run(self, actions: list[Callable]) -> list:
        return [f.result() for f in [self.pool.submit(a) for a in actions]]


class DeadlineError(TimeoutError):
    pass


def within(spark: SparkSession, seconds: float, action: Callable):
    """The result of an action on this session; its jobs are interrupted when the time is over."""
    tag, out = f"deadline-{uuid.uuid4().hex}", {}

    def work() -> None:
        spark.addTag(tag)
        try:
            out["result"] = action()
        except Exception as e:  # handed to the caller below
            out["error"] = e

    thread = threading.Thread(target=work, daemon=True)
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        spark.interruptTag(tag)
        raise DeadlineError(f"not done in {seconds} s")
    if "error" in out:
        raise out["error"]
    return out["result"]


def session(**config: str) -> SparkSession:
    """The one session of this process."""
    builder = SparkSession.builder
    for k, v in config.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def logger(name: str = "tessera", level: int = logging.INFO) -> logging.Logger:
    out = logging.getLogger(name)
    out.setLevel(level)
    return out


def set_level(spark: SparkSession, level: str) -> None:
    """Both this library's and Spark's level."""
    logger().setLevel(level)
    spark.sparkContext.setLogLevel(level)
