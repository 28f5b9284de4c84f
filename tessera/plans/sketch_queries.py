"""Sketches over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators.bloom import Bloom, ScalableBloom, guess
from tessera.operators.cms import CountMin
from tessera.operators.hll import HyperLogLog
from tessera.operators.ordering import numbered
from tessera.plans import sql
from tessera.plans.catalog import query, table

TYPES, USERS, SUPPLIERS = CountMin.guess(0.01, 0.9), CountMin(64, 4), CountMin(97, 5)


def _cms_sql(source: str, key: str, one: CountMin) -> str:
    return f"""
WITH k AS (SELECT {key}::VARCHAR AS key, count(*) AS n FROM {source} WHERE {key} IS NOT NULL GROUP BY 1),
h AS (SELECT key, n, {sql.fnv64("key")} AS h FROM k),
p AS (SELECT key, n, r, ((h % 4294967296) + (h // 4294967296) * r) % {one.width} AS col FROM h, range({one.depth}) AS t(r)),
cells AS (SELECT r, col, sum(n) AS total FROM p GROUP BY r, col)
SELECT key AS {key}, min(total)::BIGINT AS estimate FROM p JOIN cells USING (r, col) GROUP BY key
"""


@query("cms_frequency", _cms_sql("events", "event_type", TYPES))
def cms_frequency(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type")
    return TYPES.estimate(TYPES.build(events, "event_type"), events, "event_type")


@query("cms_collisions", _cms_sql("events", "user_id", USERS))
def cms_collisions(spark, sf_dir):
    """Many keys in few cells, so that estimates show the hash."""
    events = table(spark, sf_dir, "events").select("user_id")
    return USERS.estimate(USERS.build(events, "user_id"), events, "user_id")


@query("cms_merge", _cms_sql("lineitem", "l_suppkey", SUPPLIERS))
def cms_merge(spark, sf_dir):
    """Sketches of two halves, merged."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag")
    halves = [SUPPLIERS.build(lines.filter(c), "l_suppkey") for c in (F.col("l_returnflag") == "R", F.col("l_returnflag") != "R")]
    return SUPPLIERS.estimate(SUPPLIERS.merge(*halves), lines, "l_suppkey")


@query("cms_count", "SELECT count(*)::BIGINT AS count FROM lineitem WHERE l_suppkey IS NOT NULL")
def cms_count(spark, sf_dir):
    return SUPPLIERS.count(SUPPLIERS.build(table(spark, sf_dir, "lineitem"), "l_suppkey"))


def _hll_sql(one: HyperLogLog, source: str, item: str, by: str = "") -> str:
    lead, m, b = (f"{by}, " if by else ""), one.registers, one.bits
    group = f"GROUP BY {by}" if by else ""
    return f"""
WITH i AS (SELECT DISTINCT {lead}{item}::VARCHAR AS item FROM {source} WHERE {item} IS NOT NULL),
h AS (SELECT {lead}{sql.fnv32("item")} AS h FROM i),
r AS (SELECT {lead}h // {1 << (32 - b)} AS reg, max(least(CASE WHEN h = 0 THEN 65 ELSE bit_count((h & (-h)) - 1) + 1 END, {33 - b})) AS rho FROM h GROUP BY ALL),
s AS (SELECT {lead}sum(pow(2.0::DOUBLE, -rho)) AS s, count(*) AS n FROM r {group}),
e AS (SELECT {lead}{m} - n AS v, {one.alpha!r}::DOUBLE * {float(m) * m!r}::DOUBLE / ({m} - n + s) AS raw FROM s)
SELECT {lead}trunc(CASE WHEN raw <= {2.5 * m} THEN CASE WHEN v > 0 THEN {m}::DOUBLE * ln({m}::DOUBLE / v) ELSE raw END
  WHEN raw > {float(1 << 32) / 30!r} THEN -{float(1 << 32)!r} * ln(1 - raw / {float(1 << 32)!r}) ELSE raw END)::BIGINT AS estimate FROM e
"""


USERS_HLL, CUSTOMERS_HLL = HyperLogLog(1 << 10), HyperLogLog.guess(0.02)


@query("hll_cardinality", _hll_sql(USERS_HLL, "events", "user_id", "event_type"))
def hll_cardinality(spark, sf_dir):
    sketch = USERS_HLL.build(table(spark, sf_dir, "events"), "user_id", ("event_type",))
    return USERS_HLL.estimate(sketch, ("event_type",))


@query("hll_merge", _hll_sql(CUSTOMERS_HLL, "orders", "o_custkey"))
def hll_merge(spark, sf_dir):
    """Sketches by month, merged into one."""
    orders = table(spark, sf_dir, "orders").withColumn("month", F.date_trunc("month", "o_orderdate"))
    return CUSTOMERS_HLL.estimate(CUSTOMERS_HLL.merge(CUSTOMERS_HLL.build(orders, "o_custkey", ("month",))))


SIZES = [(1000, 0.01), (100_000, 0.001), (1_000_000, 0.0001)]


@query(
    "bloom_guess",
    f"""
WITH c(n, p) AS (VALUES {", ".join(f"({n}::BIGINT, {p}::DOUBLE)" for n, p in SIZES)}),
g AS (SELECT n, p, ceil(-n * ln(p) / (ln(2.0::DOUBLE) * ln(2.0::DOUBLE)))::BIGINT AS m FROM c)
SELECT n, p, m, ceil(ln(2.0::DOUBLE) * m / n)::INTEGER AS k, pow(2, greatest(9, ceil(log2(m))))::BIGINT AS m_adjusted FROM g
""",
)
def bloom_guess(spark, sf_dir):
    rows = [(n, p, *guess(n, p), Bloom.guess(n, p).m) for n, p in SIZES]
    return spark.createDataFrame(rows, "n bigint, p double, m bigint, k int, m_adjusted bigint")


MEMBERS = Bloom.guess(20_000, 0.001)


@query(
    "bloom_membership",
    f"""
WITH added AS (SELECT DISTINCT unnest({sql.bloom_cells(MEMBERS.m, MEMBERS.k)}) AS idx FROM ({sql.siphash_short("SELECT DISTINCT o_custkey::VARCHAR AS item FROM orders WHERE o_custkey IS NOT NULL")})),
asked AS (SELECT item, {sql.bloom_cells(MEMBERS.m, MEMBERS.k)} AS cells FROM ({sql.siphash_short("SELECT DISTINCT c_custkey::VARCHAR AS item FROM customer WHERE c_custkey IS NOT NULL")})),
probes AS (SELECT item, unnest(cells) AS idx FROM asked)
SELECT item AS c_custkey, count(*) = count(added.idx) AS exist FROM probes LEFT JOIN added ON probes.idx = added.idx GROUP BY item
""",
)
def bloom_membership(spark, sf_dir):
    """Which customers may have orders, by a bit filter of the orders' customers."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return MEMBERS.exist(MEMBERS.build_bits(orders, "o_custkey"), customers, "c_custkey")


@query("bloom_semi_join", "SELECT l_partkey, count(*) AS lines FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 5) GROUP BY 1")
def bloom_semi_join(spark, sf_dir):
    """Lines by part, of the parts in a filter; the exact semi join takes out what the filter lets through by chance."""
    wanted = table(spark, sf_dir, "part").filter("p_size <= 5").select("p_partkey")
    lines = table(spark, sf_dir, "lineitem").select("l_partkey")
    one = Bloom.guess(20_000, 0.01)
    maybe = one.exist(one.build_bits(wanted, "p_partkey"), lines, "l_partkey").filter("exist").select(F.col("l_partkey").cast("bigint").alias("k"))
    counts = lines.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("lines"))
    passed = counts.join(maybe, counts.l_partkey == maybe.k, "left_semi")
    return passed.join(wanted, passed.l_partkey == wanted.p_partkey, "left_semi")


@query("bloom_counting_remove", "SELECT count(*) FILTER (WHERE p_partkey % 2 = 1)::BIGINT AS kept_found FROM part")
def bloom_counting_remove(spark, sf_dir):
    """All parts are added and the even ones removed; every odd one is still found."""
    parts = table(spark, sf_dir, "part").select("p_partkey")
    one = Bloom.guess(20_000, 0.001)
    cells = one.remove(one.build(parts, "p_partkey"), parts.filter("p_partkey % 2 = 0"), "p_partkey")
    return one.exist(cells, parts.filter("p_partkey % 2 = 1"), "p_partkey").agg(F.count_if("exist").alias("kept_found"))


SCALABLE = ScalableBloom(0.01, 100)


def _layers_sql() -> str:
    from math import ceil, log

    first, parts = 0, []
    for i in range(60):
        parts.append(f"({i}, {first})")
        first += ceil(log(2) * ceil((SCALABLE.layer(i).m - 1) / SCALABLE.layer(i).k))
    return f"""
WITH b(layer, first_) AS (VALUES {", ".join(parts)}),
n AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part),
l AS (SELECT i, max(layer) AS layer FROM n JOIN b ON i >= first_ GROUP BY i)
SELECT layer::INTEGER AS layer, count(*) AS additions FROM l GROUP BY layer
"""


def _scalable_sql() -> str:
    cells, first = [], 0
    hashed = sql.siphash_short("SELECT DISTINCT p_partkey::VARCHAR AS item FROM part")
    for i in range(60):
        one = SCALABLE.layer(i)
        opened = first + SCALABLE.capacity(i)
        cells.append((i, first, opened, one.m, one.k))
        first = opened
    rows = ", ".join(f"({i}, {a}, {b}, {m}::HUGEINT, {k})" for i, a, b, m, k in cells)
    spots = f"list_distinct(list_transform(range(0, k), lambda i: ((h // ({1 << 63}::HUGEINT // (m // 2)) + (h % m) * i) % m)::BIGINT))"
    return f"""
WITH b(layer, first_, after_, m, k) AS (VALUES {rows}),
h AS ({hashed}),
n AS (SELECT item, row_number() OVER (ORDER BY item::BIGINT) - 1 AS i FROM h WHERE item::BIGINT % 3 <> 0),
added AS (SELECT DISTINCT layer, unnest({spots}) AS idx FROM n JOIN h USING (item) JOIN b ON i >= first_ AND i < after_),
open_ AS (SELECT layer, m, k FROM b WHERE first_ < (SELECT count(*) FROM n) OR layer = 0),
probes AS (SELECT item, layer, unnest({spots}) AS idx FROM h, open_),
each AS (SELECT item, probes.layer, count(*) = count(added.idx) AS exist FROM probes LEFT JOIN added ON probes.layer = added.layer AND probes.idx = added.idx GROUP BY 1, 2)
SELECT item AS p_partkey, bool_or(exist) AS exist FROM each GROUP BY 1
"""


@query("bloom_scalable_membership", _scalable_sql())
def bloom_scalable_membership(spark, sf_dir):
    """Which parts a scalable filter holds, into which two of three went."""
    parts = table(spark, sf_dir, "part").select("p_partkey")
    added = numbered(parts.filter("p_partkey % 3 != 0"), ["p_partkey"])
    additions = added.count()
    cells = SCALABLE.build(added, "p_partkey", "n", additions)
    return SCALABLE.exist(cells, parts, "p_partkey", additions)


@query("bloom_scalable_layers", _layers_sql())
def bloom_scalable_layers(spark, sf_dir):
    parts = numbered(table(spark, sf_dir, "part").select("p_partkey"), ["p_partkey"])
    additions = parts.count()
    return parts.select(SCALABLE.layer_of(F.col("n"), additions).alias("layer")).groupBy("layer").agg(F.count(F.lit(1)).alias("additions"))
