"""Operators on small tables: reference goldens, null rules, properties."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.functions.transitions import BreakerRule
from tessera.operators import allocation, caching, cluster, folds, gossip, identifiers, ordering, placement
from tessera.operators.bloom import Bloom, ScalableBloom, guess
from tessera.operators.cms import CountMin
from tessera.operators.hll import HyperLogLog


def values(df, column):
    return [r[column] for r in df.collect()]


def test_cms(spark):
    assert (CountMin.guess(0.001, 0.99).width, CountMin.guess(0.001, 0.99).depth) == (2719, 7)
    for bad in ((0, 1), (1, 0)):
        with pytest.raises(ValueError):
            CountMin(*bad)
    one = CountMin(100, 4)
    a = one.build(spark.createDataFrame([("a",), ("b",), ("b",), ("c",), (None,)], "k string"), "k")
    b = one.build(spark.createDataFrame([("b",), ("b",), ("c",), ("d",)], "k string"), "k")
    keys = spark.createDataFrame([(x,) for x in "abcdx"], "k string")
    assert {r.k: r.estimate for r in one.estimate(a, keys, "k").collect()} == {"a": 1, "b": 2, "c": 1, "d": 0, "x": 0}
    assert {r.k: r.estimate for r in one.estimate(one.merge(a, b), keys, "k").collect()} == {"a": 1, "b": 4, "c": 2, "d": 1, "x": 0}
    assert one.count(one.merge(a, b)).first()[0] == 8
    assert one.count(one.reset(a)).first()[0] == 0


def test_hll(spark):
    one = HyperLogLog.guess(0.01)
    # long items: FNV-1 leaves the last byte in the lowest bits, so short ones share registers
    items = spark.range(5000).select("id", F.md5((F.col("id") % 3000).cast("string").cast("binary")).alias("i"))
    sketch = one.build(items, "i")
    estimate = one.estimate(sketch).first()[0]
    assert abs(estimate - 3000) / 3000 < 0.05
    halves = [one.build(items.filter(f"id % 2 = {p}"), "i") for p in (0, 1)]
    assert one.estimate(one.merge(*halves)).first()[0] == estimate
    assert one.estimate(one.build(items.filter("false"), "i")).first()[0] == 0


def test_bloom(spark):
    assert guess(100_000, 0.001) == (1437759, 10)
    one = Bloom(1000, 4)
    assert one.m == 1024
    cells = one.build(spark.createDataFrame([("Boss",), ("Emotion",), (None,)], "i string"), "i")
    asked = spark.createDataFrame([("Boss",), ("Emotion",), ("Joke",)], "i string")
    assert {r.i: r.exist for r in one.exist(cells, asked, "i").collect()} == {"Boss": True, "Emotion": True, "Joke": False}
    gone = one.remove(cells, spark.createDataFrame([("Boss",), ("Joke",)], "i string"), "i")
    assert {r.i: r.exist for r in one.exist(gone, asked, "i").collect()} == {"Boss": False, "Emotion": True, "Joke": False}
    big = Bloom.guess(100_000, 0.001)
    assert big.false_positive(100_000) <= 0.001


def test_scalable_bloom(spark):
    one = ScalableBloom(0.01, 200)
    added = spark.range(999).select((F.col("id") + 1).cast("string").alias("i"), "id")
    cells = one.build(added, "i", "id", 999)
    assert len(one.bounds(999)) > 1
    probed = spark.range(1, 4001).select(F.col("id").cast("string").alias("i"))
    found = {r.i for r in one.exist(cells, probed, "i", 999).collect() if r.exist}
    assert {str(i) for i in range(1, 1000)} <= found
    assert len(found) - 999 <= 2 * one.false_positive(999) * 3001 + 5
    assert one.false_positive(999) < 0.05


def test_scalable_bloom_of_thousands_of_layers(spark):
    one, additions = ScalableBloom(0.01, 100), 1_200_000
    bounds = one.bounds(additions)
    assert len(bounds) > 5000 and one.p * one.r ** len(bounds) == 0
    numbers = spark.range(0, additions, 6007)
    got = {r.id: r.layer for r in numbers.select("id", one.layer_of(F.col("id"), additions).alias("layer")).collect()}
    assert got == {n: sum(b <= n for b in bounds) - 1 for n in range(0, additions, 6007)}


def test_scalable_bloom_cells(spark, monkeypatch):
    """Against bitmaps of plain Python, with layers as bitmaps and as tables of cells, and few hashes and layers at once."""
    from tessera.functions.hashing import siphash24
    from tessera.operators import bloom

    one, additions = ScalableBloom(0.01, 100), 60_000
    bounds = one.bounds(additions)
    items, asked = [str(7 * i) for i in range(3000)], [str(i) for i in range(0, 24_000, 5)]

    hashes = {x: int(h) for x, h in zip([*items, *asked], siphash24([x.encode() for x in [*items, *asked]]))}

    def cells(layer, item):
        filter_, h = one.layer(layer), hashes[item]
        bits = filter_.m.bit_length() - 1
        return {((h >> (64 - bits)) + (h & (filter_.m - 1)) * i) & (filter_.m - 1) for i in range(filter_.k)}

    def check(items, asked, step, additions):
        bounds, filled = one.bounds(additions), {}
        for i, x in enumerate(items):
            layer = sum(b <= i * step for b in bounds) - 1
            filled[layer] = filled.get(layer, set()) | cells(layer, x)
        rows = spark.createDataFrame([(x, i * step) for i, x in enumerate(items)] + [(None, 0)], "i string, n bigint")
        built = one.build(rows, "i", "n", additions)
        got = {r.i: r.exist for r in one.exist(built, spark.createDataFrame([(x,) for x in [*asked, *asked[:3], None]], "i string"), "i", additions).collect()}
        assert got == {x: any(cells(layer, x) <= f for layer, f in filled.items()) for x in asked}

    assert len(bounds) > 300
    check(items[:400], asked[:300], 150, additions)
    check(items[:600], asked, 1, 600)  # full layers, so some are found by chance
    monkeypatch.setattr(bloom, "BLOCK", 100)
    monkeypatch.setattr(bloom, "LAYERS", 2)
    monkeypatch.setattr(bloom, "WHOLE_BITS", 1 << 10)
    check(items[:600], asked[:500], 1, 600)


def test_order(spark):
    rows = spark.createDataFrame([(v, v % 3) for v in [5, 3, 9, 9, 1, 7, None or 4]], "v int, g int")
    assert values(ordering.sort_values(rows, "v"), "v") == sorted(values(rows, "v"))
    assert values(ordering.top_k(rows, "v", 2), "v") == [9, 9]
    assert ordering.kth_smallest(rows, "v", 6).first()[0] == 9
    assert ordering.kth_smallest(rows, "v", 99).count() == 0
    with pytest.raises(ValueError):
        ordering.kth_smallest(rows, "v", 0)


def test_numbering_is_dense_whatever_the_partitions(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"))
    numbered = ordering.numbered(rows, ["k"]).orderBy("k").collect()
    assert [r.n for r in numbered] == list(range(1000))
    sums = ordering.running_sum(rows, ["k"], F.lit(3), "s").orderBy("k").collect()
    assert [r.s for r in sums] == list(range(0, 3000, 3))
    assert ordering.numbered(rows.filter("false"), ["k"]).count() == 0


def test_running_greatest_and_ranks_beyond_the_heap(spark, monkeypatch):
    rows = spark.range(2000).select("id", F.when(F.col("id") % 7 != 0, F.col("id") * 7919 % 1009).alias("v"))
    plain, best = [], None
    for r in rows.orderBy("id").collect():
        best = max((x for x in (best, r.v) if x is not None), default=None)
        plain.append(best)
    assert [r.m for r in ordering.running_max(rows, ["id"], F.col("v"), "m").orderBy("id").collect()] == plain
    monkeypatch.setattr(ordering, "HEAP", 0)
    known = sorted(r.v for r in rows.collect() if r.v is not None)
    for k in (1, 2, 900, len(known)):
        assert ordering.kth_smallest(rows, "v", k).first()[0] == known[k - 1]
    assert ordering.kth_smallest(rows, "v", len(known) + 1).count() == 0
    assert ordering.kth_smallest(rows.withColumn("v", F.format_string("%04d", "id")), "v", 1234).first()[0] == "1233"
    plan = ordering.numbered(rows, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_ordered_map(spark):
    ops = [("set", "A", 1), ("set", "B", 2), ("set", "C", 3), ("set", "D", 4), ("set", "E", 5), ("set", "C", 9), ("remove", "X", 0), ("remove", "D", 0)]
    log = spark.createDataFrame([(i, *o) for i, o in enumerate(ops)], "seq int, op string, key string, value bigint")
    table = ordering.ordered_upsert(log, "key", "value", "seq", "op")
    scan = {r.key: (r.value, r.next_key) for r in ordering.ordered_scan(table).collect()}
    assert scan == {"A": (1, "B"), "B": (2, "C"), "C": (9, "E"), "E": (5, None)}
    assert tuple(ordering.front(table).first()) == ("A", 1)
    assert ordering.get(table, "D").count() == 0
    assert values(ordering.key_range(table, "B", "E"), "key") == ["B", "C"]


def test_ids(spark):
    start = datetime(2020, 1, 1)
    rows = spark.createDataFrame([(i, start + timedelta(seconds=i // 50), 1 + i % 3) for i in range(300)], "e int, ts timestamp, n int")
    reserved = identifiers.reserved_ids(rows, ["ts", "e"], "n").orderBy("e").collect()
    assert all(b.id == a.id + a.n for a, b in zip(reserved, reserved[1:])) and reserved[0].id == 0
    flakes = [r.id for r in identifiers.flake_ids(rows, ["ts", "e"], "ts").orderBy("e").collect()]
    assert all(b > a for a, b in zip(flakes, flakes[1:]))
    assert identifiers.flake_bits(30) == 18
    with pytest.raises(Exception, match="positive"):
        identifiers.reserved_ids(rows.withColumn("n", F.lit(0)), ["ts", "e"], "n").collect()


def test_ring(spark):
    nodes = ["127.0.0.1:80", "192.168.0.1:80", "10.0.0.1:80"]
    ring = placement.BoundedRing(nodes, balance=1.02)
    for i in range(100):
        ring.place(f"key{i}")
        assert max(ring.load.values()) <= placement.max_load(ring.total, 3, 1.02)
    assert placement.max_load(100, 3, 1.02) == 34
    lookup = placement.RingLookup(placement.ring(spark.createDataFrame([(n,) for n in nodes], "node string")))
    placed = spark.range(500).select(F.col("id").cast("string").alias("k")).select("k", lookup.node_of("k").alias("n"))
    before = {r.k: r.n for r in placed.collect()}
    assert set(before.values()) == set(nodes)
    fewer = placement.remove_nodes(placement.ring(spark.createDataFrame([(n,) for n in nodes], "node string")), spark.createDataFrame([(nodes[0],)], "node string"))
    after = {r.k: r.n for r in placed.select("k", placement.RingLookup(fewer).node_of("k").alias("n")).collect()}
    assert all(after[k] == n for k, n in before.items() if n != nodes[0])
    with pytest.raises(ValueError):
        placement.BoundedRing([]).least("k")


def test_subsets_cover_disjointly(spark):
    backends = spark.range(300).select(F.col("id").cast("string").alias("backend"))
    clients = spark.range(60).select(F.col("id").alias("client"))
    by_round = {}
    for r in placement.subsets(backends, clients, 10).collect():
        by_round.setdefault(r.client // 30, []).append(r.backend)
    assert all(len(b) == 300 == len(set(b)) for b in by_round.values())
    with pytest.raises(ValueError):
        placement.subsets(backends, clients, 301)


def test_folds(spark):
    t = datetime(2024, 1, 1)
    calls = spark.createDataFrame([("k", t + timedelta(milliseconds=100 * (i // 3)), i) for i in range(6)] + [(None, t, 9)], "key string, ts timestamp, id int")
    allowed = {r.id: r.allowed for r in folds.token_bucket(calls, "key", "ts", "id", 10.0, 1).collect()}
    assert [allowed[i] for i in range(6)] == [True, False, False, True, False, False]
    seconds = spark.createDataFrame([("k", t, i) for i in range(5)] + [("k", t + timedelta(seconds=10), 5), ("k", t + timedelta(seconds=10), 6)], "key string, ts timestamp, id int")
    assert [r.allowed for r in folds.second_counter(seconds, "key", "ts", "id", 1).orderBy("id").collect()] == [True, False, False, False, False, True, False]
    failing = folds.circuit_breaker(seconds, "key", "ts", "id", F.lit(False), BreakerRule(should_trip=lambda c: c.failures_in_row >= 2))
    assert [r.verdict for r in failing.orderBy("id").collect()] == ["allowed", "allowed"] + ["open"] * 5
    last = folds.latest_n(spark.createDataFrame([("k", 1, 11), ("k", 2, 12), ("k", 3, None), ("k", 4, 14)], "key string, seq int, v int"), "key", ["seq"], "v", 3)
    assert [r["values"] for r in last.orderBy("seq").collect()] == [[None, None, 11], [None, 11, 12], [11, 12, None], [12, None, 14]]
    log = spark.createDataFrame([("k", 1, "push_left", 1), ("k", 2, "push_right", 2), ("k", 3, "pop_left", None)], "key string, seq int, op string, v int")
    assert folds.deques(log, "key", "seq", "op", "v").first()["items"] == [2]


def test_caching(spark):
    trace = spark.createDataFrame([(i, f"myKey{i}") for i in range(22)], "seq int, key string")
    assert {r.key for r in caching.lru_contents(trace, "key", ["seq"], 20).collect()} == {f"myKey{i}" for i in range(2, 22)}
    log = trace.select(F.lit("c").alias("cache"), "seq", F.lit("add").alias("op"), "key")
    assert [r.key for r in caching.lru_log(log, "cache", "seq", "op", "key", 20).orderBy("purged").collect()] == ["myKey0", "myKey1"]
    truth = spark.createDataFrame([("a", 1), ("b", 2)], "key string, value int")
    asked = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "k string")
    answers, cache = caching.read_through(asked, "k", truth.filter("key = 'b'"), truth)
    assert {(r.key, r.value, r.truth_calls) for r in answers.collect()} == {("a", 1, 1), ("b", 2, 0), ("c", None, 1)}
    assert {r.key for r in cache.collect()} == {"a", "b"}


def test_fair_allocation():
    one = allocation.FairAllocator({"CPU": 9, "MEMORY": 18}, {"A": {"CPU": 1, "MEMORY": 4}, "B": {"CPU": 3, "MEMORY": 1}})
    assert one.run() == {"A": 3, "B": 2}
    assert (one.allocated["A"]["CPU"], one.allocated["B"]["CPU"]) == (3, 6)
    with pytest.raises(allocation.SaturatedError):
        one.next_task()
    one.update_resource({"CPU": 9, "MEMORY": 18})
    one.add_node("C", {"CPU": 1})
    assert one.next_task() == "C"
    for bad in (({}, {"A": {"CPU": 1}}), ({"CPU": 1}, {})):
        with pytest.raises(ValueError):
            allocation.FairAllocator(*bad)


def test_gossip_conserves_mass(spark):
    readings = spark.createDataFrame([("a", 45.0), ("b", 55.0), ("c", 65.0)], "node string, v double")
    found = {r.node: r.estimate for r in gossip.push_sum(readings, "node", "v", rounds=48).collect()}
    assert all(abs(v - 55) < 0.01 for v in found.values()) and len(found) == 3
    assert gossip.average(readings, "v").first()[0] == 55


def test_cluster(spark):
    assert sorted(cluster.in_step(spark.range(8), 2, lambda rows: sum(1 for _ in rows), lambda p, n: (p, n))) [0][0] == 0
    assert cluster.Permits(2).run([lambda i=i: i * i for i in range(5)]) == [0, 1, 4, 9, 16]
    assert cluster.within(spark, 60, lambda: spark.range(3).count()) == 3
    with pytest.raises(cluster.DeadlineError):
        cluster.within(spark, 0.2, lambda: __import__("time").sleep(3))
    with pytest.raises(ZeroDivisionError):
        cluster.within(spark, 60, lambda: 1 / 0)
    assert cluster.session() is spark
