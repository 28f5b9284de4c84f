"""Topics and subscriptions: tables of messages, and one streaming query with its own checkpoint per subscription."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: What a topic's payloads may be.
PAYLOADS = ("string", "binary")


class Topic:
    """A folder of Parquet messages under the project's folder. Payloads are strings, or bytes that are kept as they are."""

    def __init__(self, project: Project, name: str, payload: str = "string"):
        if payload not in PAYLOADS:
            raise ValueError(f"payloads are one of {PAYLOADS}")
        self.project, self.name, self.payload = project, name, payload
        self.path = f"{project.folder}/topics/{name}"
        self.subscriptions: dict[str, StreamingQuery] = {}
        self.stopped = False

    @property
    def schema(self) -> str:
        return f"id string, data {self.payload}"

    def errors(self) -> dict[str, str]:
        """What subscriptions failed with, by name."""
        return {name: str(query.exception()) for name, query in self.subscriptions.items() if query.exception() is not None}

    def publish(self, messages: DataFrame) -> None:
        """Messages ``data`` get an id unless they have one; they stay for later subscriptions too."""
        if self.stopped:
            raise RuntimeError("the topic is stopped")
        ids = F.col("id") if "id" in messages.columns else F.expr("uuid()")
        messages.select(ids.cast("string").alias("id"), F.col("data").cast(self.payload).alias("data")).write.mode("append").parquet(self.path)

    def subscribe(self, name: str, receive: Callable[[DataFrame, int], None], workers: int = 1, once: bool = False) -> StreamingQuery:
        """Every subscription gets every message; ``receive(messages, batch)`` sees a ``worker`` column that deals each message to one of its workers."""
        if name in self.subscriptions and self.subscriptions[name].isActive:
            raise ValueError(f"subscription {name} exists")
        stream = self.project.spark.readStream.schema(self.schema).parquet(self.path)
        dealt = stream.withColumn("worker", worker_of(F.col("id"), workers))
        writer = dealt.writeStream.foreachBatch(receive).option("checkpointLocation", f"{self.project.folder}/subscriptions/{self.name}/{name}")
        query = (writer.trigger(availableNow=True) if once else writer).start()
        self.subscriptions[name] = query
        return query

    def unsubscribe(self, name: str) -> None:
        self.subscriptions.pop(name).stop()

    def stop(self) -> None:
        """No more messages; what was published is delivered first."""
        self.stopped = True
        for query in self.subscriptions.values():
            if query.isActive:
                query.processAllAvailable()
                query.stop()


class Project:
    def __init__(self, spark: SparkSession, name: str, folder: str):
        self.spark, self.name, self.folder = spark, f"projects/{name}", folder
        self.topics: dict[str, Topic] = {}

    def new_topic(self, name: str, payload: str = "string") -> Topic:
        if name in self.topics:
            raise ValueError(f"topic {name} exists")
        self.topics[name] = Topic(self, name, payload)
        self.spark.createDataFrame([], self.topics[name].schema).write.mode("append").parquet(self.topics[name].path)
        return self.topics[name]

    def delete_topic(self, name: str) -> None:
        self.topics.pop(name).stop()


def worker_of(id_, workers: int):
    """One of the competing workers, by a hash of the message."""
    digest = F.substring(F.md5(id_.cast("string").cast("binary")), 1, 8)
    return F.pmod(F.conv(digest, 16, 10).cast("bigint"), F.lit(workers)).cast("int")


def fan_out(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """``subscription`` with each message: the bounded form. ``subscriptions`` is ``topic, subscription``; messages have a ``topic``."""
    return messages.join(subscriptions, "topic")
