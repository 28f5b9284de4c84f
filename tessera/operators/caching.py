"""What caches do with an access trace."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.transitions import LruCache
from tessera.operators.folds import by_key


def lru_contents(trace: DataFrame, key: str, seq: list[str], capacity: int) -> DataFrame:
    """``key``: what a least-recently-used cache holds after the trace: the keys of latest last access (all of them if capacity is 0)."""
    last = trace.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(F.struct(*seq)).alias("last"))
    return (last.orderBy(F.desc("last")).limit(capacity) if capacity else last).select("key")


def lru_hits(trace: DataFrame, key: str, seq: list[str], capacity: int, by: str) -> DataFrame:
    """``by, hits, misses``: caches of one capacity, one for each value of ``by``, run over its trace. A trace's order makes it one task's work; it is read as a stream of Arrow batches and only the cache is kept."""
    kept = trace.filter(F.col(key).isNotNull() & F.col(by).isNotNull()).select(by, key, *seq)

    def run(frames):
        cache, now, hits, misses = LruCache(capacity), None, 0, 0
        for pdf in frames:
            for b, k in zip(pdf[by], pdf[key]):
                if b != now:
                    if hits + misses:
                        yield pd.DataFrame({by: [now], "hits": [hits], "misses": [misses]})
                    cache, now, hits, misses = LruCache(capacity), b, 0, 0
                if cache.get(k) is None:
                    misses += 1
                    cache.add(k, True)
                    cache.purged.clear()
                else:
                    hits += 1
        if hits + misses:
            yield pd.DataFrame({by: [now], "hits": [hits], "misses": [misses]})

    schema = T.StructType([trace.schema[by], T.StructField("hits", T.LongType()), T.StructField("misses", T.LongType())])
    return kept.repartition(by).sortWithinPartitions(by, *seq).select(by, key).mapInPandas(run, schema)


def lru_log(log: DataFrame, cache: str, seq: str, op: str, key: str, capacity: int) -> DataFrame:
    """``cache, purged, key``: keys in the order they were purged, from a log of add, get, remove, remove_oldest and clear."""

    def run(name, rows):
        one, purged = LruCache(capacity), 0
        for _, _, o, k in rows:
            if o == "add":
                one.add(k, True)
            elif o in ("get", "remove"):
                getattr(one, o)(k)
            else:
                getattr(one, o)()
            for gone, _ in one.purged:
                yield name, purged, gone
                purged += 1
            one.purged.clear()

    schema = T.StructType([log.schema[cache], T.StructField("purged", T.LongType()), log.schema[key]])
    return by_key(log.select(cache, seq, op, key), cache, [seq], run, schema)


def read_through(requests: DataFrame, key: str, cached: DataFrame, truth: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answers ``key, value, truth_calls`` for each different requested key, and the cache after them.

    Keys that the cache (``key, value``) lacks are looked up in ``truth`` once,
    however often they are asked for; unknown ones stay null and are not cached.
    """
    asked = requests.filter(F.col(key).isNotNull()).select(F.col(key).alias("key")).distinct()
    hits = asked.join(cached, "key").withColumn("truth_calls", F.lit(0))
    fetched = asked.join(cached, "key", "left_anti").join(truth, "key", "left").withColumn("truth_calls", F.lit(1))
    return hits.unionByName(fetched), cached.unionByName(fetched.filter("value IS NOT NULL").select("key", "value"))
