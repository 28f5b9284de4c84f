"""Placement, caching, allocation and gossip over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.hashing import JumpHasher, jump_bucket, jump_bucket_string
from tessera.operators import allocation, caching, gossip, placement
from tessera.operators.ordering import numbered
from tessera.plans import sql
from tessera.plans.catalog import query, table

BUCKETS = 10


@query("jump_bucket", f"WITH RECURSIVE s AS (SELECT o_orderkey AS id, o_orderkey::HUGEINT AS key FROM orders), {sql.jump_walk('s', BUCKETS)} SELECT id AS o_orderkey, max(b)::INTEGER AS bucket FROM walk GROUP BY id")
def jump_buckets(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", JumpHasher(BUCKETS)("o_orderkey").alias("bucket"))


@query("jump_bucket_string", f"WITH RECURSIVE s AS (SELECT c_name AS id, {sql.crc64('c_name')}::HUGEINT AS key FROM customer), {sql.jump_walk('s', 16)} SELECT id AS c_name, max(b)::INTEGER AS bucket FROM walk GROUP BY id")
def jump_bucket_strings(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_name", jump_bucket_string("c_name", 16).alias("bucket"))


@query("jump_repartition", f"WITH RECURSIVE s AS (SELECT o_orderkey AS id, o_orderkey::HUGEINT AS key FROM orders), {sql.jump_walk('s', 4)} SELECT bucket, count(*) AS keys FROM (SELECT id, max(b)::INTEGER AS bucket FROM walk GROUP BY id) GROUP BY 1")
def jump_repartition(spark, sf_dir):
    dealt = table(spark, sf_dir, "orders").select("o_orderkey", jump_bucket("o_orderkey", 4).alias("bucket"))
    return dealt.repartition(4, "bucket").groupBy("bucket").agg(F.count(F.lit(1)).alias("keys"))


def _ring_sql(source: str, key: str) -> str:
    """CTEs ``r`` (the ring of nations) and ``placed`` (``key, node``)."""
    return f"""
v AS (SELECT DISTINCT n_name AS node, n_name || i::VARCHAR AS name FROM nation, range({placement.REPLICAS}) AS t(i)),
r AS (SELECT {sql.crc64("name")} AS point, max(node) AS node FROM v GROUP BY 1),
k AS (SELECT {key}::VARCHAR AS key FROM {source}),
h AS (SELECT key, {sql.crc64("key")} AS h FROM k),
placed AS (SELECT h.key, coalesce(r.node, (SELECT arg_min(node, point) FROM r)) AS node FROM h ASOF LEFT JOIN r ON h.h <= r.point)"""


@query("ring_lookup", f"WITH {_ring_sql('customer', 'c_name')} SELECT key AS c_name, node FROM placed")
def ring_lookup(spark, sf_dir):
    lookup = placement.RingLookup(placement.ring(table(spark, sf_dir, "nation"), "n_name"))
    return table(spark, sf_dir, "customer").select("c_name", lookup.node_of("c_name").alias("node"))


@query("ring_loads", f"WITH {_ring_sql('orders', 'o_orderkey')} SELECT node, count(*)::BIGINT AS load FROM placed GROUP BY node")
def ring_loads(spark, sf_dir):
    """Keys by node on the ring of nations."""
    lookup = placement.RingLookup(placement.ring(table(spark, sf_dir, "nation"), "n_name"))
    placed = table(spark, sf_dir, "orders").select(lookup.node_of(F.col("o_orderkey").cast("string")).alias("node"), F.lit(1).alias("delta"))
    return placement.loads(placed)


_BOUND = "ceil(greatest(1, (list_sum(load) + 1) // 5) * 1.25)"


@query(
    "ring_bounded_load",
    f"""
WITH RECURSIVE v AS (SELECT r_name AS node, r_name || i::VARCHAR AS name FROM region, range({placement.REPLICAS}) AS t(i)),
r AS (SELECT {sql.crc64("name")} AS point, max(node) AS node FROM v GROUP BY 1),
names AS (SELECT list(r_name ORDER BY r_name) AS names FROM region),
k AS (SELECT s_nationkey, s_suppkey, s_name, {sql.crc64("s_name")} AS h, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey, s_name) AS i FROM supplier WHERE s_name IS NOT NULL AND s_nationkey IS NOT NULL),
w AS (SELECT s_nationkey, s_suppkey, s_name, i, list(list_position(names, node) ORDER BY point < h, point) AS walk FROM k, r, names GROUP BY ALL),
s AS (
  SELECT s_nationkey, 0::BIGINT AS i, 0::BIGINT AS s_suppkey, '' AS s_name, 0 AS pick, [0, 0, 0, 0, 0] AS load FROM (SELECT DISTINCT s_nationkey FROM k)
  UNION ALL
  SELECT s_nationkey, i, s_suppkey, s_name, pick, list_transform(load, lambda x, j: x + (j = pick)::INT)
  FROM (SELECT w.*, load, list_filter(walk, lambda n: load[n] + 1 <= {_BOUND})[1] AS pick FROM s JOIN w ON w.s_nationkey = s.s_nationkey AND w.i = s.i + 1))
SELECT s_nationkey, s_name, s_suppkey, names[pick] AS node FROM s, names WHERE i > 0
""",
)
def ring_bounded_load(spark, sf_dir):
    """Suppliers of each nation, one after another, on the five regions within the load bound."""
    nodes = [r.r_name for r in table(spark, sf_dir, "region").select("r_name").collect()]
    return placement.place_bounded(table(spark, sf_dir, "supplier"), "s_name", "s_suppkey", nodes, "s_nationkey")


def _left_sql() -> str:
    gone = "r AS (SELECT * FROM every WHERE node NOT IN (SELECT n_name FROM nation WHERE n_regionkey = 1)),"
    return _ring_sql("customer", "c_name").replace("r AS (SELECT", "every AS (SELECT").replace("k AS (SELECT c_name", f"{gone} k AS (SELECT c_name")


@query("ring_after_removal", f"WITH {_left_sql()} SELECT node, count(*)::BIGINT AS load FROM placed GROUP BY node")
def ring_after_removal(spark, sf_dir):
    """Keys by node after the nations of one region left the ring."""
    nations = table(spark, sf_dir, "nation")
    left = placement.remove_nodes(placement.ring(nations, "n_name"), nations.filter("n_regionkey = 1").select(F.col("n_name").alias("node")))
    placed = table(spark, sf_dir, "customer").select(placement.RingLookup(left).node_of("c_name").alias("node"), F.lit(1).alias("delta"))
    return placement.loads(placed)


TOTALS = [(0, 3), (1, 3), (100, 3), (99, 4), (7, 10)]


@query("ring_max_load", f"SELECT total, nodes, ceil(greatest(1, greatest(1, total) // nodes) * 1.25)::BIGINT AS max_load FROM (VALUES {', '.join(f'({t}::BIGINT, {n}::BIGINT)' for t, n in TOTALS)}) AS v(total, nodes)")
def ring_max_load(spark, sf_dir):
    return spark.createDataFrame([(t, n, placement.max_load(t, n)) for t, n in TOTALS], "total bigint, nodes bigint, max_load bigint")


@query(
    "client_subset",
    """
WITH c AS (SELECT s_suppkey AS client, s_suppkey // 6 AS round, s_suppkey % 6 AS part FROM supplier),
s AS (SELECT round, n_name AS backend, (row_number() OVER (PARTITION BY round ORDER BY md5(round::VARCHAR || ':' || n_name), n_name) - 1) // 4 AS part FROM (SELECT DISTINCT round FROM c), nation)
SELECT client, backend FROM c JOIN s USING (round, part)
""",
)
def client_subset(spark, sf_dir):
    return placement.subsets(table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier"), 4, "n_name", "s_suppkey")


@query("lane_assignment", "SELECT lane, count(*) AS events FROM (SELECT ((row_number() OVER (ORDER BY ts, event_id) - 1) % 8)::INTEGER AS lane FROM events) GROUP BY lane")
def lane_assignment(spark, sf_dir):
    events = numbered(table(spark, sf_dir, "events").select("event_id", "ts"), ["ts", "event_id"])
    return events.select(placement.round_robin_lane(F.col("n"), 8).alias("lane")).groupBy("lane").agg(F.count(F.lit(1)).alias("events"))


@query("lru_contents", "SELECT l_partkey AS key FROM lineitem GROUP BY l_partkey ORDER BY max(struct_pack(a := l_orderkey, b := l_linenumber)) DESC LIMIT 100")
def lru_contents(spark, sf_dir):
    return caching.lru_contents(table(spark, sf_dir, "lineitem"), "l_partkey", ["l_orderkey", "l_linenumber"], 100)


@query(
    "lru_hits",
    """
WITH t AS (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL),
p AS (SELECT *, lag(i) OVER (PARTITION BY event_type, user_id ORDER BY i) AS before FROM t),
d AS (SELECT p.event_type, p.i, count(DISTINCT m.user_id) AS between_ FROM p JOIN t m ON m.event_type = p.event_type AND m.i > p.before AND m.i < p.i GROUP BY 1, 2),
h AS (SELECT p.event_type, p.before IS NOT NULL AND coalesce(d.between_, 0) < 50 AS hit FROM p LEFT JOIN d ON d.event_type = p.event_type AND d.i = p.i)
SELECT event_type, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses FROM h GROUP BY 1
""",
)
def lru_hits(spark, sf_dir):
    """A cache of 50 users for each type of event."""
    return caching.lru_hits(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], 50, "event_type")


@query(
    "lru_log",
    """
WITH RECURSIVE e AS (SELECT user_id, (event_id % 4)::BIGINT AS key, CASE event_id % 11 WHEN 3 THEN 'get' WHEN 5 THEN 'remove' WHEN 8 THEN 'remove_oldest' WHEN 10 THEN 'clear' ELSE 'add' END AS op,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events WHERE user_id IS NOT NULL),
s AS (
  SELECT user_id, 0::BIGINT AS i, []::BIGINT[] AS held, []::BIGINT[] AS gone FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL
  SELECT user_id, i,
    CASE WHEN op IN ('add', 'get') THEN (CASE WHEN len(moved) > 2 THEN moved[2:] ELSE moved END)
         WHEN op = 'remove' THEN list_filter(held, lambda x: x <> key) WHEN op = 'remove_oldest' THEN held[2:] ELSE [] END,
    gone || CASE WHEN op IN ('add', 'get') THEN (CASE WHEN len(moved) > 2 THEN moved[:1] ELSE [] END)
         WHEN op = 'remove' THEN list_filter(held, lambda x: x = key) WHEN op = 'remove_oldest' THEN held[:1] ELSE held END
  FROM (SELECT e.*, held, gone, CASE WHEN op = 'add' OR list_contains(held, key) THEN list_append(list_filter(held, lambda x: x <> key), key) ELSE held END AS moved
        FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)),
z AS (SELECT user_id, arg_max(gone, i) AS gone FROM s GROUP BY 1)
SELECT user_id, unnest(range(0, len(gone))) AS purged, unnest(gone) AS key FROM z
""",
)
def lru_log(spark, sf_dir):
    """A cache of two entries for each user, with adds, gets and removals."""
    kinds = F.when(F.col("k") == 3, "get").when(F.col("k") == 5, "remove").when(F.col("k") == 8, "remove_oldest").when(F.col("k") == 10, "clear").otherwise("add")
    log = table(spark, sf_dir, "events").filter("user_id IS NOT NULL").withColumn("k", F.col("event_id") % 11).select("user_id", "event_id", kinds.alias("op"), (F.col("event_id") % 4).alias("key"))
    return caching.lru_log(log, "user_id", "event_id", "op", "key", 2)


@query(
    "lease_read_through",
    """
SELECT user_id AS key, c_name AS value, CASE WHEN user_id % 3 = 0 AND c_name IS NOT NULL THEN 0 ELSE 1 END::INTEGER AS truth_calls
FROM (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL) LEFT JOIN customer ON c_custkey = user_id
""",
)
def lease_read_through(spark, sf_dir):
    """Users' names: every third customer is in the cache already."""
    truth = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))
    answers, _ = caching.read_through(table(spark, sf_dir, "events"), "user_id", truth.filter("key % 3 = 0"), truth)
    return answers


@query(
    "drf_allocation",
    """
WITH RECURSIVE n AS (
  SELECT n_regionkey AS cluster, list(n_name ORDER BY n_name) AS names, list((1 + n_nationkey % 4)::DOUBLE ORDER BY n_name) AS cpu, list((1 + n_nationkey % 7)::DOUBLE ORDER BY n_name) AS memory
  FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1),
s AS (
  SELECT *, list_transform(names, lambda x: 0::BIGINT) AS t, 0 AS step FROM n
  UNION ALL
  SELECT cluster, names, cpu, memory, list_transform(t, lambda x, i: x + (i = pick)::BIGINT), step + 1
  FROM (SELECT *, list_position(share, list_min(share)) AS pick
        FROM (SELECT *, list_transform(t, lambda x, i: greatest(x * cpu[i] / 90::DOUBLE, x * memory[i] / 180::DOUBLE)) AS share FROM s))
  WHERE list_sum(list_transform(t, lambda x, i: x * cpu[i])) + cpu[pick] <= 90 AND list_sum(list_transform(t, lambda x, i: x * memory[i])) + memory[pick] <= 180),
z AS (SELECT cluster, arg_max(t, step) AS t FROM s GROUP BY 1),
e AS (SELECT cluster, unnest(names) AS node, unnest(t) AS tasks, unnest(cpu) AS cpu, unnest(memory) AS memory FROM z JOIN n USING (cluster))
SELECT cluster, node, tasks, greatest(tasks * cpu / 90::DOUBLE, tasks * memory / 180::DOUBLE) AS share FROM e
""",
)
def drf_allocation(spark, sf_dir):
    """Nations share their region's capacity."""
    nations = table(spark, sf_dir, "nation")
    demands = nations.select(F.col("n_regionkey").alias("cluster"), F.col("n_name").alias("node"), F.create_map(F.lit("cpu"), (1 + F.col("n_nationkey") % 4).cast("double"), F.lit("memory"), (1 + F.col("n_nationkey") % 7).cast("double")).alias("demand"))
    resources = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("cluster"), F.create_map(F.lit("cpu"), F.lit(90.0), F.lit("memory"), F.lit(180.0)).alias("resource"))
    return allocation.allocate(demands, resources)


@query("gossip_average", "WITH b AS (SELECT c_nationkey, avg(c_acctbal) AS v FROM customer GROUP BY 1) SELECT c_nationkey AS node, round((SELECT avg(v) FROM b), 2) AS estimate FROM b")
def gossip_average(spark, sf_dir):
    means = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("v"))
    found = gossip.push_sum(means, "c_nationkey", "v", rounds=64)
    return found.select("node", F.round("estimate", 2).alias("estimate"))
