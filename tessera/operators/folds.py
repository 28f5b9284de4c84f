"""Keyed stateful operators over bounded tables.

A key's events are ordered by time, then by their id, so ties are settled. Where
the recurrence is a window, it stays in the JVM. Otherwise a key's events are
sorted in its partition and read as a stream of Arrow batches by the shared step
functions: a task holds one batch and the state of one key, however many events
a key has. Null keys and, where time counts, null times are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import transitions as step


def _sorted(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows of a key one after another, in order, nulls last."""
    return df.repartition(key).sortWithinPartitions(key, *(F.col(c).asc_nulls_last() for c in order))


def in_turn(df: DataFrame, key: str, order: list[str], begin: Callable[[object], object], advance: Callable, reads: list[str], drop: tuple[str, ...] = (), **added: T.DataType) -> DataFrame:
    """The rows with the columns ``added``: for each key a state from ``begin(key)``, moved on by ``advance(state, *reads)``, which gives the state and the row's values."""
    kept = df.filter(F.col(key).isNotNull())
    schema = T.StructType([*(f for f in kept.schema.fields if f.name not in drop), *(T.StructField(n, t) for n, t in added.items())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for pdf in frames:
            found = []
            for k, *row in zip(pdf[key], *(pdf[c] for c in reads)):
                if state is None or (k != now and k == k):
                    now, state = k, begin(k)
                state, *values = advance(state, *row)
                found.append(values)
            values = {n: pd.Series([v[i] for v in found], index=pdf.index, dtype=object) for i, n in enumerate(added)}
            yield pdf.drop(columns=list(drop)).assign(**values)

    return _sorted(kept, key, order).mapInPandas(run, schema)


def by_key(df: DataFrame, key: str, order: list[str], run: Callable[[object, Iterator[tuple]], Iterator[tuple]], schema: T.StructType, most: int = 4096) -> DataFrame:
    """The rows of ``run(key, rows)`` for each key; its rows come one by one, in order."""
    kept = df.filter(F.col(key).isNotNull())
    names, at = [f.name for f in schema.fields], kept.columns.index(key)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype=object) for i, n in enumerate(names)})

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for k, rows in groupby((row for pdf in frames for row in pdf.itertuples(index=False, name=None)), lambda row: row[at]):
            for found in run(k, rows):
                out.append(found)
                if len(out) == most:
                    yield frame(out)
                    out = []
        yield frame(out)

    return _sorted(kept, key, order).mapInPandas(work, schema)


def _timed(df: DataFrame, ts: str) -> DataFrame:
    """Events that have a time, with it in microseconds as ``_at``."""
    return df.filter(F.col(ts).isNotNull()).withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp")))


def token_bucket(df: DataFrame, key: str, ts: str, id_: str, limit: float, burst: int, n: Column | None = None) -> DataFrame:
    """``key, ts, id, n, allowed``: whether each request finds its tokens. Times count in microseconds."""
    asked = df.select(key, ts, id_, (F.lit(1) if n is None else n).cast("int").alias("n"))

    def advance(state, at, many):
        return step.bucket_allow(state, int(at) * 1000, int(many), limit, burst)

    return in_turn(_timed(asked, ts), key, ["_at", id_], lambda k: step.Bucket(), advance, ["_at", "n"], ("_at",), allowed=T.BooleanType())


def token_waits(df: DataFrame, key: str, ts: str, id_: str, limit: float, burst: int, n: Column | None = None) -> DataFrame:
    """``key, ts, id, n, wait_ns``: how long each request would have to wait for its tokens, among requests that take theirs where they find them; null where it would be in vain."""
    asked = df.select(key, ts, id_, (F.lit(1) if n is None else n).cast("int").alias("n"))

    def advance(state, at, many):
        wait = step.bucket_wait(state, int(at) * 1000, int(many), limit, burst)
        return step.bucket_allow(state, int(at) * 1000, int(many), limit, burst)[0], wait

    return in_turn(_timed(asked, ts), key, ["_at", id_], lambda k: step.Bucket(), advance, ["_at", "n"], ("_at",), wait_ns=T.LongType())


def second_counter(df: DataFrame, key: str, ts: str, id_: str, limit: int, n: Column | None = None) -> DataFrame:
    """``key, ts, id, allowed``: a counter for each key and second, raised first and compared then, so refused calls count too."""
    window = Window.partitionBy(key, F.date_trunc("second", F.col(ts))).orderBy(ts, id_).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.sum(F.lit(1) if n is None else n).over(window)
    return df.filter(F.col(key).isNotNull()).select(key, ts, id_, (seen <= limit).alias("allowed"))


def second_counts(df: DataFrame, ts: str) -> DataFrame:
    """``second, count``: events in tumbling windows of one second."""
    return df.groupBy(F.date_trunc("second", F.col(ts)).alias("second")).count()


def circuit_breaker(df: DataFrame, key: str, ts: str, id_: str, success: Column, rule: step.BreakerRule = step.BreakerRule()) -> DataFrame:
    """``key, ts, id, success, verdict, state``: whether each call was let through and the state after it."""
    calls = df.select(key, ts, id_, success.alias("success"))

    def advance(b, at, ok):
        b, verdict = step.breaker_call(b, at / 1e6, bool(ok), rule)
        return b, verdict, b.state

    return in_turn(_timed(calls, ts), key, ["_at", id_], lambda k: step.Breaker(), advance, ["_at", "success"], ("_at",), verdict=T.StringType(), state=T.StringType())


def batches(df: DataFrame, key: str, ts: str, id_: str, count: int, timeout: float) -> DataFrame:
    """``key, ts, id, batch``: batches that end by number or time, numbered from 0 for each key; the last one is kept though it is not full."""
    if not 1 <= count < 1 << 32:
        raise ValueError("count must be from 1 to 2^32 - 1")

    def advance(state, at):
        return step.batch_step(state, at / 1e6, count, timeout)

    return in_turn(_timed(df.select(key, ts, id_), ts), key, ["_at", id_], lambda k: step.Batcher(), advance, ["_at"], ("_at",), batch=T.LongType())


def latest(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """``key, value``: the newest value of each key."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(value, F.struct(*order)).alias("value"))


def latest_n(df: DataFrame, key: str, order: list[str], value: str, n: int) -> DataFrame:
    """``key, order, values``: at each event the last n values, oldest first, nulls on the left until there are n."""
    if n < 1:
        raise ValueError("n must be positive")
    window = Window.partitionBy(key).orderBy(*order).rowsBetween(-(n - 1), 0)
    # structs, since lists of plain values leave nulls out
    found = F.transform(F.collect_list(F.struct(F.col(value).alias("v"))).over(window), lambda x: x["v"])
    kind = df.schema[value].dataType
    padding = F.array_repeat(F.lit(None).cast(kind), F.lit(n))
    joined = F.concat(padding, found)
    return df.filter(F.col(key).isNotNull()).select(key, *order, F.slice(joined, -n, n).alias("values"))


def deques(log: DataFrame, key: str, seq: str, op: str, value: str) -> DataFrame:
    """``key, items``: each key's double-ended queue after its log of push_left, push_right, pop_left, pop_right and remove."""
    kind = log.schema[value].dataType

    def run(k, rows):
        yield k, step.deque_fold((op, value) for _, _, op, value in rows)[0]

    schema = T.StructType([log.schema[key], T.StructField("items", T.ArrayType(kind))])
    return by_key(log.select(key, seq, op, value), key, [seq], run, schema)


def backoff(retries: Column, base: float, cap: float) -> Column:
    """Exponential delay: base times two to the number of retries, at most the cap."""
    if cap < base:
        raise ValueError("the cap is below the base")
    return F.least(F.lit(float(cap)), F.pow(F.lit(2.0), F.least(retries, F.lit(1000))) * base)


def backoff_full(retries: Column, base: float, cap: float, seed: int) -> Column:
    return backoff(retries, base, cap) * F.rand(seed)


def backoff_equal(retries: Column, base: float, cap: float, seed: int) -> Column:
    e = backoff(retries, base, cap)
    return e / 2 + e / 2 * F.rand(seed)


def backoff_decorrelated(df: DataFrame, key: str, retries: str, base: float, cap: float, seed: int) -> DataFrame:
    """``key, retries, delay``: each delay is drawn from base to three times the one before it, from base again at no retries."""

    def advance(one, many):
        return one, one(int(many))

    return in_turn(df.select(key, retries), key, [retries], lambda k: step.Backoff(base, cap, "decorrelated", f"{seed}:{k}"), advance, [retries], delay=T.DoubleType())
