"""Order statistics, ordered tables, ids and codecs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import codecs
from tessera.functions.codecs import ALPHABET, RANDOM_BASE, RANDOM_FLIP, RANDOM_OFFSET, RANDOM_PRIME
from tessera.operators import identifiers, ordering
from tessera.plans.catalog import query, table


@query("sort_values", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice")
def sort_values(spark, sf_dir):
    return ordering.sort_values(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice")


@query("top_k", "SELECT l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC LIMIT 100")
def top_k(spark, sf_dir):
    return ordering.top_k(table(spark, sf_dir, "lineitem").select("l_extendedprice"), "l_extendedprice", 100)


@query("kth_smallest", "SELECT l_extendedprice AS value FROM lineitem ORDER BY l_extendedprice LIMIT 1 OFFSET 999")
def kth_smallest(spark, sf_dir):
    return ordering.kth_smallest(table(spark, sf_dir, "lineitem"), "l_extendedprice", 1000)


@query("kth_smallest_by_group", "SELECT l_returnflag, value FROM (SELECT l_returnflag, l_extendedprice AS value, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS n FROM lineitem) WHERE n = 10")
def kth_smallest_by_group(spark, sf_dir):
    return ordering.kth_smallest(table(spark, sf_dir, "lineitem"), "l_extendedprice", 10, ("l_returnflag",))


UPSERTED = """(SELECT key, value FROM (SELECT user_id::VARCHAR AS key, event_id AS value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE user_id IS NOT NULL) WHERE n = 1 AND event_type <> 'error')"""


def _upserted(spark, sf_dir):
    """Events as a change log: an error removes its user, other events set the user's value."""
    events = table(spark, sf_dir, "events")
    log = events.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("value"), F.struct("ts", "event_id").alias("seq"), F.when(F.col("event_type") == "error", "remove").otherwise("set").alias("op"))
    return ordering.ordered_upsert(log, "key", "value", "seq", "op")


@query("ordered_upsert", f"SELECT * FROM {UPSERTED}")
def ordered_upsert(spark, sf_dir):
    return _upserted(spark, sf_dir)


@query("ordered_scan", f"SELECT key, value, lead(key) OVER (ORDER BY key COLLATE C) AS next_key FROM {UPSERTED}")
def ordered_scan(spark, sf_dir):
    return ordering.ordered_scan(_upserted(spark, sf_dir))


@query("ordered_range", f"SELECT * FROM {UPSERTED} WHERE key >= '1' AND key < '3'")
def ordered_range(spark, sf_dir):
    return ordering.key_range(_upserted(spark, sf_dir), "1", "3")


@query("ordered_front", f"SELECT min(key) AS key, arg_min(value, key) AS value FROM {UPSERTED}")
def ordered_front(spark, sf_dir):
    return ordering.front(_upserted(spark, sf_dir))


@query("dense_ids", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS id FROM events")
def dense_ids(spark, sf_dir):
    return identifiers.dense_ids(table(spark, sf_dir, "events").select("event_id", "ts"), ["ts", "event_id"]).select("event_id", "id")


@query("reserve_ids", "SELECT event_id, coalesce(sum(1 + event_id % 5) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS id FROM events")
def reserve_ids(spark, sf_dir):
    asked = table(spark, sf_dir, "events").select("event_id", "ts", (1 + F.col("event_id") % 5).alias("n"))
    return identifiers.reserved_ids(asked, ["ts", "event_id"], "n").select("event_id", "id")


START = int(identifiers.FLAKE_START.timestamp())


@query(
    "flake_ids",
    f"""
WITH e AS (SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, (floor(epoch(ts))::BIGINT - {START}) * 1000 * {1 << identifiers.FLAKE_BITS} AS t FROM events)
SELECT event_id, max(t - i) OVER (ORDER BY ts, event_id) + i AS id FROM e
""",
)
def flake_ids(spark, sf_dir):
    return identifiers.flake_ids(table(spark, sf_dir, "events").select("event_id", "ts"), ["ts", "event_id"], "ts").select("event_id", "id")


@query(
    "flake_ranges",
    f"""
WITH e AS (SELECT event_id, ts, coalesce(sum(1 + event_id % 3) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s, (floor(epoch(ts))::BIGINT - {START}) * 1000 * {1 << identifiers.FLAKE_BITS} AS t FROM events)
SELECT event_id, (max(t - s) OVER (ORDER BY ts, event_id) + s)::BIGINT AS id, (1 + event_id % 3)::BIGINT AS n FROM e
""",
)
def flake_ranges(spark, sf_dir):
    """Each event reserves one to three ids."""
    asked = table(spark, sf_dir, "events").select("event_id", "ts", (1 + F.col("event_id") % 3).alias("n"))
    return identifiers.flake_ranges(asked, ["ts", "event_id"], "ts", "n").select("event_id", "id", "n")


def _permuted(x: str) -> str:
    r = f"((({x})::HUGEINT * ({x})::HUGEINT) % {RANDOM_PRIME})::BIGINT"
    return f"(CASE WHEN ({x}) >= {RANDOM_PRIME} THEN ({x}) WHEN ({x}) <= {RANDOM_PRIME // 2} THEN {r} ELSE {RANDOM_PRIME} - {r} END)"


SEEDS = (1, 2)


@query(
    "random_sequence",
    f"""
WITH n AS (SELECT n, ({_permuted(f"({_permuted(str(SEEDS[0]))} + {RANDOM_BASE}) % 4294967296")} + n) % 4294967296 AS i,
           {_permuted(f"({_permuted(str(SEEDS[1]))} + {RANDOM_OFFSET}) % 4294967296")} AS o FROM range(10000) AS t(n)),
x AS (SELECT n, xor(({_permuted("i")} + o) % 4294967296, {RANDOM_FLIP}) AS x FROM n)
SELECT n, {_permuted("x")}::BIGINT AS value FROM x
""",
)
def random_sequence(spark, sf_dir):
    return spark.range(10_000).select(F.col("id").alias("n"), codecs.random_sequence(F.col("id"), *SEEDS).alias("value"))


_POWERS = ", ".join(f"{58**k}::HUGEINT" for k in range(10, -1, -1))


@query(
    "base58_encode",
    f"SELECT o_orderkey, CASE WHEN o_orderkey = 0 THEN '1' ELSE ltrim(array_to_string(list_transform([{_POWERS}], lambda p: substr('{ALPHABET}', ((o_orderkey // p) % 58)::INT + 1, 1)), ''), '1') END AS text FROM orders",
)
def base58_encode(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", codecs.base58_encode(F.col("o_orderkey")).alias("text"))


@query("base58_reverse", "SELECT c_custkey, reverse(c_custkey::VARCHAR) AS reversed FROM customer")
def base58_reverse(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", codecs.base58_reverse(F.col("c_custkey").cast("string")).alias("reversed"))


@query("base58_decode", "SELECT o_orderkey, o_orderkey AS decoded FROM orders")
def base58_decode(spark, sf_dir):
    encoded = table(spark, sf_dir, "orders").select("o_orderkey", codecs.base58_encode(F.col("o_orderkey")).alias("text"))
    return encoded.select("o_orderkey", codecs.base58_decode(F.col("text")).cast("bigint").alias("decoded"))


@query(
    "bitflag_ops",
    """
WITH f AS (SELECT event_id, (user_id & 255)::INTEGER AS f, (event_id % 10)::INTEGER AS n FROM events)
SELECT event_id, (f | 5)::SMALLINT AS set_all, xor(f, 15)::SMALLINT AS toggle_all, (f & 252)::SMALLINT AS clear_all,
       (f & 3) <> 0 AND (f & 4) <> 0 AS are_all_set, (f & 1) <> 0 OR (f & 8) <> 0 AS is_any_set,
       n <= 7 AND (f & (1 << least(n, 7))) <> 0 AS is_set,
       CASE WHEN n <= 7 THEN f | (1 << least(n, 7)) ELSE f END::SMALLINT AS bit_set,
       CASE WHEN n <= 7 THEN xor(f, 1 << least(n, 7)) ELSE f END::SMALLINT AS bit_toggled,
       CASE WHEN n <= 7 THEN f & (255 - (1 << least(n, 7))) ELSE f END::SMALLINT AS bit_cleared, 0::SMALLINT AS reset
FROM f
""",
)
def bitflag_ops(spark, sf_dir):
    f, n = F.col("f"), F.col("n")
    flags = table(spark, sf_dir, "events").select("event_id", F.col("user_id").bitwiseAND(F.lit(255)).cast("int").alias("f"), (F.col("event_id") % 10).cast("int").alias("n"))
    return flags.select(
        "event_id",
        codecs.flag_set_all(f, 1, 4).alias("set_all"),
        codecs.flag_toggle_all(f, 3, 12).alias("toggle_all"),
        codecs.flag_clear_all(f, 1, 2).alias("clear_all"),
        codecs.flag_are_all_set(f, 3, 4).alias("are_all_set"),
        codecs.flag_is_any_set(f, 1, 8).alias("is_any_set"),
        codecs.flag_is_set(f, n).alias("is_set"),
        codecs.flag_set(f, n).alias("bit_set"),
        codecs.flag_toggle(f, n).alias("bit_toggled"),
        codecs.flag_clear(f, n).alias("bit_cleared"),
        codecs.flag_reset().alias("reset"),
    )


@query("bitflag_aggregate", "SELECT event_type, bit_or(user_id & 255) AS any_of, bit_and(user_id & 255) AS all_of, bit_xor(user_id & 255) AS odd_of FROM events GROUP BY 1")
def bitflag_aggregate(spark, sf_dir):
    f = F.col("user_id").bitwiseAND(F.lit(255))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.bit_or(f).alias("any_of"), F.bit_and(f).alias("all_of"), F.bit_xor(f).alias("odd_of"))


@query("tlv_encode", "SELECT p_partkey, printf('%02X', p_size % 256) || printf('%02X', strlen(p_name) % 256) || printf('%02X', strlen(p_name) // 256) || hex(encode(p_name)) AS record FROM part")
def tlv_encode(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.hex(codecs.tlv_encode(F.col("p_size"), F.col("p_name").cast("binary"))).alias("record"))


@query("tlv_decode", "SELECT p_partkey, (p_size % 256)::BIGINT AS type, p_name AS payload FROM part")
def tlv_decode(spark, sf_dir):
    records = table(spark, sf_dir, "part").select("p_partkey", codecs.tlv_encode(F.col("p_size"), F.col("p_name").cast("binary")).alias("record"))
    return records.select("p_partkey", codecs.tlv_decode(F.col("record")).alias("r")).select("p_partkey", "r.type", F.col("r.payload").cast("string").alias("payload"))
