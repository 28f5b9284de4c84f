"""The keyed step functions as stateful streaming operators.

They need ``spark.sql.streaming.stateStore.providerClass`` to be the RocksDB
provider. A key's events are handled in order of time within each micro-batch.
Streams of TIMESTAMP_NTZ must be cast to TIMESTAMP before they get a watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.functions import transitions as step

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _sorted(rows: Iterator[pd.DataFrame], ts: str, id_: str) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values([ts, id_], kind="stable")


class _Keyed(StatefulProcessor):
    """Folds a key's events through a step function; the state is one row."""

    state_schema = ""

    def __init__(self, key: str, ts: str, id_: str):
        self.key, self.ts, self.id_ = key, ts, id_

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", self.state_schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _sorted(rows, self.ts, self.id_)
        state = self.load(self.state.get() if self.state.exists() else None)
        out = []
        for event in pdf.itertuples(index=False):
            state, result = self.step(state, event)
            out.append(result)
        self.state.update(self.save(state))
        yield pd.DataFrame({self.key: key[0], self.id_: pdf[self.id_].to_numpy(), self.result: out})

    def close(self) -> None:
        pass


class BucketProcessor(_Keyed):
    state_schema, result = "tokens double, last bigint", "allowed"

    def __init__(self, key, ts, id_, limit: float, burst: int):
        super().__init__(key, ts, id_)
        self.limit, self.burst = limit, burst

    def load(self, row):
        return step.Bucket() if row is None else step.Bucket(row[0], row[1])

    def save(self, s):
        return (s.tokens, s.last)

    def step(self, s, event):
        return step.bucket_allow(s, pd.Timestamp(getattr(event, self.ts)).value, 1, self.limit, self.burst)


class BreakerProcessor(_Keyed):
    state_schema, result = "state string, generation bigint, requests bigint, successes bigint, failures bigint, successes_in_row bigint, failures_in_row bigint, expiry double", "verdict"

    def __init__(self, key, ts, id_, success: str, rule: step.BreakerRule):
        super().__init__(key, ts, id_)
        self.success, self.rule = success, rule

    def load(self, row):
        return step.Breaker() if row is None else step.Breaker(row[0], row[1], step.Counts(*row[2:7]), row[7])

    def save(self, b):
        c = b.counts
        return (b.state, b.generation, c.requests, c.successes, c.failures, c.successes_in_row, c.failures_in_row, b.expiry)

    def step(self, b, event):
        return step.breaker_call(b, pd.Timestamp(getattr(event, self.ts)).value / 1e9, bool(getattr(event, self.success)), self.rule)


class BatchProcessor(_Keyed):
    state_schema, result = "batch bigint, size bigint, began double", "batch"

    def __init__(self, key, ts, id_, count: int, timeout: float):
        super().__init__(key, ts, id_)
        self.count, self.timeout = count, timeout

    def load(self, row):
        return step.Batcher() if row is None else step.Batcher(*row)

    def save(self, s):
        return (s.batch, s.size, s.began)

    def step(self, s, event):
        return step.batch_step(s, pd.Timestamp(getattr(event, self.ts)).value / 1e9, self.count, self.timeout)


class LatestProcessor(StatefulProcessor):
    """Keeps each key's last n values (as text) and gives them, oldest first, after each micro-batch."""

    def __init__(self, key: str, ts: str, id_: str, value: str, n: int):
        if n < 1:
            raise ValueError("n must be positive")
        self.key, self.ts, self.id_, self.value, self.n = key, ts, id_, value, n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("values", "value string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _sorted(rows, self.ts, self.id_)
        held = [r[0] for r in self.state.get()] + [None if pd.isna(v) else str(v) for v in pdf[self.value]]
        held = held[-self.n :]
        self.state.put([(v,) for v in held])
        yield pd.DataFrame({self.key: key[0], "values": [[None] * (self.n - len(held)) + held]})

    def close(self) -> None:
        pass


def _run(stream: DataFrame, key: str, processor: StatefulProcessor, *fields: T.StructField) -> DataFrame:
    schema = T.StructType([stream.schema[key], *fields])
    return stream.filter(F.col(key).isNotNull()).groupBy(key).transformWithStateInPandas(processor, schema, outputMode="Append", timeMode="None")


def token_bucket(stream: DataFrame, key: str, ts: str, id_: str, limit: float, burst: int) -> DataFrame:
    return _run(stream, key, BucketProcessor(key, ts, id_, limit, burst), stream.schema[id_], T.StructField("allowed", T.BooleanType()))


def circuit_breaker(stream: DataFrame, key: str, ts: str, id_: str, success: str, rule: step.BreakerRule = step.BreakerRule()) -> DataFrame:
    return _run(stream, key, BreakerProcessor(key, ts, id_, success, rule), stream.schema[id_], T.StructField("verdict", T.StringType()))


def batches(stream: DataFrame, key: str, ts: str, id_: str, count: int, timeout: float) -> DataFrame:
    return _run(stream, key, BatchProcessor(key, ts, id_, count, timeout), stream.schema[id_], T.StructField("batch", T.LongType()))


def latest_n(stream: DataFrame, key: str, ts: str, id_: str, value: str, n: int) -> DataFrame:
    return _run(stream, key, LatestProcessor(key, ts, id_, value, n), T.StructField("values", T.ArrayType(T.StringType())))


def second_counts(stream: DataFrame, ts: str, lateness: str = "10 seconds") -> DataFrame:
    """``second, count`` of tumbling seconds, each given once the watermark is past it."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", lateness)
    return timed.groupBy(F.window("_ts", "1 second").alias("w")).count().select(F.col("w.start").alias("second"), "count")
