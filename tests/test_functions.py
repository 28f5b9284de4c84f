"""Golden values and properties of hashes, codecs and step functions."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import codecs, hashing
from tessera.functions import transitions as step

MANY = settings(max_examples=150, deadline=None)


@pytest.mark.parametrize(("key", "buckets", "bucket"), [(1, 1, 0), (42, 57, 43), (0xDEAD10CC, 1, 0), (0xDEAD10CC, 666, 361), (256, 1024, 520), (0, -10, 0)])
def test_jump_golden(key, buckets, bucket):
    assert hashing.jump(np.array([key], np.uint64), buckets)[0] == bucket


@pytest.mark.parametrize(("key", "bucket"), [("localhost", 6), ("中国", 1)])
def test_jump_string_golden(spark, key, bucket):
    assert spark.createDataFrame([(key,)], "k string").select(hashing.jump_bucket_string("k", 10)).first()[0] == bucket


def test_jump_hasher_needs_buckets():
    with pytest.raises(ValueError):
        hashing.JumpHasher(0)


def test_hash_goldens():
    assert int(hashing.crc64([b"123456789"])[0]) == 0x995DC9BBDF1939FA
    assert int(hashing.fnv1_64([b"a"])[0]) == 12638153115695167422
    assert hashing.fnv1_64([b""])[0] == hashing.FNV64_OFFSET
    # the published vector of SipHash-2-4: key 00..0f, message 00..0e
    assert int(hashing.siphash24([bytes(range(15))], bytes(range(16)))[0]) == 0xA129CA6149BE45E5


@MANY
@given(st.lists(st.binary(max_size=40), min_size=1, max_size=6))
def test_kernels_agree_with_plain_loops(items):
    def fnv(data, h, prime, bits):
        for b in data:
            h = (h * prime % (1 << bits)) ^ b
        return h

    assert [int(x) for x in hashing.fnv1_64(items)] == [fnv(i, hashing.FNV64_OFFSET, hashing.FNV64_PRIME, 64) for i in items]
    assert [int(x) for x in hashing.fnv1_32(items)] == [fnv(i, hashing.FNV32_OFFSET, hashing.FNV32_PRIME, 32) for i in items]
    assert [int(x) for x in hashing.siphash24(items)] == [int(hashing.siphash24([i])[0]) for i in items]
    assert [int(x) for x in hashing.crc64(items)] == [int(hashing.crc64([i])[0]) for i in items]


def test_one_long_item_does_not_pad_all_others():
    items = [str(i).encode() for i in range(10_000)] + [b"x" * (1 << 20)]
    for kernel in (hashing.fnv1_64, hashing.fnv1_32, hashing.crc64, hashing.siphash24):
        got = kernel(items)
        assert got[77] == kernel(items[77:78])[0] and got[-1] == kernel(items[-1:])[0]


def test_hashes_of_nulls(spark):
    rows = spark.createDataFrame([("a",), ("",), ("中国",), (None,)], "s string")
    got = rows.select(hashing.fnv1_32_hash("s").alias("b"), hashing.siphash_hash("s").alias("c")).collect()
    assert all(r.b is not None and r.c is not None for r in got[:3])
    assert (got[3].b, got[3].c) == (None, None)


BASE58 = [(0, "1"), (32, "Z"), (57, "z"), (255, "5Q"), (65535, "LUv"), (4294967295, "7YXq9G"), (18446744073709551615, "jpXCZedGfVQ")]


def test_base58(spark):
    from decimal import Decimal

    rows = spark.createDataFrame([(Decimal(n), t) for n, t in BASE58], "n decimal(20,0), t string")
    got = rows.select("n", "t", codecs.base58_encode(F.col("n")).alias("e"), codecs.base58_decode(F.col("t")).alias("d")).collect()
    assert all(r.e == r.t and r.d == r.n for r in got)
    bad = spark.createDataFrame([("",), ("0",), ("aO",), (None,)], "t string").select(codecs.base58_decode(F.col("t")).alias("d")).collect()
    assert [r.d for r in bad] == [None] * 4


def test_flags(spark):
    f = spark.createDataFrame([(0b1010,)], "f int")
    row = f.select(
        codecs.flag_are_all_set(F.col("f")).alias("none"),
        codecs.flag_are_all_set(F.col("f"), 3, 8).alias("some"),
        codecs.flag_is_any_set(F.col("f")).alias("any"),
        codecs.flag_is_set(F.col("f"), F.lit(8)).alias("high"),
        codecs.flag_set(F.col("f"), F.lit(9)).alias("same"),
        codecs.flag_clear(F.col("f"), F.lit(1)).alias("cleared"),
    ).first()
    assert tuple(row) == (True, True, False, False, 10, 8)


def test_random_sequence_has_no_repeats(spark):
    values = [r[0] for r in spark.range(100_000).select(codecs.random_sequence(F.col("id"), 1, 2)).collect()]
    assert len(set(values)) == len(values) and 0 <= min(values) and max(values) < 1 << 32


def test_bucket_golden():
    s, out = step.Bucket(), []
    for ms, n in ((0, 1), (0, 1), (0, 1), (100, 1), (100, 1), (100, 1), (200, 2), (200, 1), (200, 1)):
        s, ok = step.bucket_allow(s, ms * 1_000_000, n, 10.0, 1)
        out.append(ok)
    assert out == [True, False, False, True, False, False, False, True, False]


def test_bucket_wait_takes_nothing():
    s, _ = step.bucket_allow(step.Bucket(), 0, 1, 10.0, 1)
    assert step.bucket_wait(s, 0, 2, 10.0, 1) is None
    assert step.bucket_wait(s, 0, 1, 10.0, 1) == 100_000_000
    assert step.bucket_wait(s, 200_000_000, 1, 10.0, 1) == 0


def test_breaker_default_and_custom():
    b, rule = step.Breaker(), step.BreakerRule()
    for i in range(5):
        b, _ = step.breaker_call(b, i, False, rule)
    assert b.state == step.CLOSED
    b, _ = step.breaker_call(b, 5, False, rule)
    assert b.state == step.OPEN
    assert step.breaker_call(b, 65, True, rule)[1] == "open"
    b, verdict = step.breaker_call(b, 66, True, rule)
    assert (b.state, verdict) == (step.CLOSED, "allowed")
    rule = step.BreakerRule(max_requests=3, interval=30, timeout=90, should_trip=lambda c: c.requests >= 3 and c.failures / c.requests >= 0.6)
    b = step.Breaker()
    for ok in (True, False, False):
        b, _ = step.breaker_call(b, 1, ok, rule)
    assert b.state == step.OPEN
    b, first = step.breaker_before(step.breaker_at(b, 92, rule), 92, rule)
    b, _ = step.breaker_before(b, 92, rule)
    b, _ = step.breaker_before(b, 92, rule)
    assert first == "allowed" and step.breaker_before(b, 92, rule)[1] == "too many"
    old = b.generation - 1
    assert step.breaker_after(b, old, 93, False, rule) == b  # of an older generation
    assert step.breaker_after(b, b.generation, 93, False, rule).state == step.OPEN


def test_batches_end_by_count_or_time():
    s, out = step.Batcher(), []
    for i in range(10):
        s, n = step.batch_step(s, 0.0, 10, 1.0)
        out.append(n)
    assert out == [0] * 10 and s == step.Batcher(1, 0, 0.0)
    s, a = step.batch_step(step.Batcher(), 0.0, 100, 1.0)
    s, b = step.batch_step(s, 0.5, 100, 1.0)
    s, c = step.batch_step(s, 1.2, 100, 1.0)
    s, d = step.batch_step(s, 9.9, 100, 1.0)
    assert (a, b, c, d) == (0, 0, 1, 2)


def test_backoff():
    assert [step.Backoff(1, 2)(n) for n in range(10)] == [1.0] + [2.0] * 9
    with pytest.raises(ValueError):
        step.Backoff(2, 1)
    with pytest.raises(ValueError):
        step.Backoff(1, 2, "other")


@MANY
@given(st.sampled_from(["full", "equal", "decorrelated"]), st.integers(0, 60), st.integers(0, 9))
def test_jitter_bounds(strategy, retries, seed):
    e = step.backoff_exponential(0.5, 30.0, retries)
    low, high = {"full": (0, e), "equal": (e / 2, e), "decorrelated": (0.5, 30.0)}[strategy]
    assert low <= step.Backoff(0.5, 30.0, strategy, seed)(retries) <= high


def test_every():
    assert step.every(0.5) == 2
    with pytest.raises(ValueError):
        step.every(0)


def test_lru_golden():
    cache = step.LruCache(20)
    for i in range(22):
        cache.add(f"myKey{i}", 1234)
    assert [k for k, _ in cache.purged] == ["myKey0", "myKey1"] and len(cache) == 20
    cache.remove("myKey5")
    cache.clear()
    assert len(cache) == 0 and len(cache.purged) == 22
    with pytest.raises(ValueError):
        step.LruCache(-1)


def test_deque():
    items, results = step.deque_fold([("push_left", 1), ("push_right", 2), ("remove", 1), ("remove", 1), ("pop_left", None), ("pop_right", None)])
    assert items == [] and results == [None, None, 1, None, 2, None]
