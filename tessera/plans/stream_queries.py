"""Messaging, limits and resilience over the driver's events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import folds
from tessera.operators.storage import new_path
from tessera.plans.catalog import query, table
from tessera.streaming import processors, pubsub

KEY, TS, ID = "user_id", "ts", "event_id"


@query("latest_value", "SELECT user_id, arg_max(event_id, struct_pack(a := ts, b := event_id)) AS value FROM events WHERE user_id IS NOT NULL GROUP BY user_id")
def latest_value(spark, sf_dir):
    return folds.latest(table(spark, sf_dir, "events"), KEY, [TS, ID], ID)


@query(
    "latest_n",
    """
SELECT event_id, coalesce(lag(event_id, 2) OVER w::VARCHAR, '-') || ',' || coalesce(lag(event_id, 1) OVER w::VARCHAR, '-') || ',' || event_id::VARCHAR AS last_three
FROM events WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""".replace("lag(event_id, 2) OVER w::VARCHAR", "(lag(event_id, 2) OVER w)::VARCHAR").replace("lag(event_id, 1) OVER w::VARCHAR", "(lag(event_id, 1) OVER w)::VARCHAR"),
)
def latest_n(spark, sf_dir):
    found = folds.latest_n(table(spark, sf_dir, "events"), KEY, [TS, ID], ID, 3)
    return found.select("event_id", F.array_join(F.col("values").cast("array<string>"), ",", "-").alias("last_three"))


SUBSCRIPTIONS = [("click", "audit"), ("click", "billing"), ("purchase", "audit"), ("purchase", "billing"), ("purchase", "mail"), ("error", "audit")]
_VALUES = ", ".join(f"('{t}', '{s}')" for t, s in SUBSCRIPTIONS)


@query("pubsub_fanout", f"SELECT subscription, count(*) AS messages FROM events JOIN (VALUES {_VALUES}) AS s(topic, subscription) ON event_type = topic GROUP BY 1")
def pubsub_fanout(spark, sf_dir):
    messages = table(spark, sf_dir, "events").select(F.col("event_type").alias("topic"), F.col("event_id").alias("id"))
    subscriptions = spark.createDataFrame(SUBSCRIPTIONS, "topic string, subscription string")
    return pubsub.fan_out(messages, subscriptions).groupBy("subscription").agg(F.count(F.lit(1)).alias("messages"))


@query("pubsub_workers", "SELECT (('0x' || substr(md5(event_id::VARCHAR), 1, 8))::BIGINT % 4)::INTEGER AS worker, count(*) AS messages FROM events GROUP BY 1")
def pubsub_workers(spark, sf_dir):
    return table(spark, sf_dir, "events").select(pubsub.worker_of(F.col("event_id"), 4).alias("worker")).groupBy("worker").agg(F.count(F.lit(1)).alias("messages"))


LIMIT, BURST = 0.001, 2  # a request each thousand seconds


@query(
    "token_bucket",
    f"""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) * 1000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE user_id IS NOT NULL),
s AS (
  SELECT user_id, event_id, i, t AS last, {BURST - 1}::DOUBLE AS tokens, TRUE AS allowed FROM e WHERE i = 1
  UNION ALL
  SELECT user_id, event_id, i, CASE WHEN have >= 1 THEN t ELSE last END, CASE WHEN have >= 1 THEN have - 1 ELSE tokens END, have >= 1
  FROM (SELECT e.*, s.last, s.tokens, least(s.tokens + least(e.t - s.last, trunc(1000000000::DOUBLE * (({BURST} - s.tokens) / {LIMIT}::DOUBLE))) / 1000000000::DOUBLE * {LIMIT}::DOUBLE, {BURST}::DOUBLE) AS have
        FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1))
SELECT user_id, event_id, allowed FROM s
""",
)
def token_bucket(spark, sf_dir):
    return folds.token_bucket(table(spark, sf_dir, "events"), KEY, TS, ID, LIMIT, BURST).select(KEY, ID, "allowed")


@query("second_counter_limiter", "SELECT event_type, event_id, count(*) OVER (PARTITION BY event_type, date_trunc('second', ts) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= 1 AS allowed FROM events WHERE event_type IS NOT NULL")
def second_counter_limiter(spark, sf_dir):
    return folds.second_counter(table(spark, sf_dir, "events"), "event_type", TS, ID, 1).select("event_type", ID, "allowed")


SECONDS = "SELECT date_trunc('second', ts) AS second, count(*) AS count FROM events GROUP BY 1"


@query("second_window_counts", SECONDS)
def second_window_counts(spark, sf_dir):
    return folds.second_counts(table(spark, sf_dir, "events"), TS)


@query("second_window_counts_stream", SECONDS)
def second_window_counts_stream(spark, sf_dir):
    """The same counts by a stream that reads all there is and ends."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")
    where = new_path(spark, "stream")

    def keep(batch, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/counts")

    counts = processors.second_counts(stream, TS)
    counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(f"{where}/counts")
    return found.select(F.col("second").cast("timestamp_ntz").alias("second"), "count")


COUNT, TIMEOUT = 5, 3600


@query(
    "batch_count_or_time",
    f"""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1000000.0::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE user_id IS NOT NULL),
s AS (
  SELECT user_id, event_id, i, 0::BIGINT AS batch, 0::BIGINT AS following, 1::BIGINT AS size, t AS began FROM e WHERE i = 1
  UNION ALL
  SELECT user_id, event_id, i, now_, CASE WHEN n + 1 >= {COUNT} THEN now_ + 1 ELSE now_ END, CASE WHEN n + 1 >= {COUNT} THEN 0 ELSE n + 1 END, CASE WHEN n + 1 >= {COUNT} THEN t ELSE start_ END
  FROM (SELECT e.user_id, e.event_id, e.t, e.i,
          CASE WHEN e.t - s.began >= {TIMEOUT} THEN s.following + (s.size > 0)::BIGINT ELSE s.following END AS now_,
          CASE WHEN e.t - s.began >= {TIMEOUT} THEN 0 ELSE s.size END AS n,
          CASE WHEN e.t - s.began >= {TIMEOUT} THEN s.began + floor((e.t - s.began) / {TIMEOUT}) * {TIMEOUT} ELSE s.began END AS start_
        FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1))
SELECT user_id, event_id, batch FROM s
""",
)
def batch_count_or_time(spark, sf_dir):
    return folds.batches(table(spark, sf_dir, "events"), KEY, TS, ID, COUNT, TIMEOUT).select(KEY, ID, "batch")


# the state before an event (cur) follows from the state after the one before it and the time; two failures in a row trip
@query(
    "circuit_breaker",
    """
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1000000.0::DOUBLE AS t, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE user_id IS NOT NULL),
s AS (
  SELECT user_id, event_id, i, 'allowed' AS verdict, 'closed' AS state, CASE WHEN ok THEN 0 ELSE 1 END AS failures, NULL::DOUBLE AS expiry FROM e WHERE i = 1
  UNION ALL
  SELECT user_id, event_id, i, CASE WHEN cur = 'open' THEN 'open' ELSE 'allowed' END,
         CASE WHEN cur = 'open' THEN 'open' WHEN ok THEN 'closed' WHEN cur = 'half-open' OR failures + 1 >= 2 THEN 'open' ELSE 'closed' END,
         CASE WHEN cur = 'open' OR ok OR cur = 'half-open' OR failures + 1 >= 2 THEN 0 ELSE failures + 1 END,
         CASE WHEN cur = 'open' THEN expiry WHEN NOT ok AND (cur = 'half-open' OR failures + 1 >= 2) THEN t + 3600 END
  FROM (SELECT e.*, s.failures, s.expiry, CASE WHEN s.state = 'open' AND s.expiry < e.t THEN 'half-open' ELSE s.state END AS cur
        FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1))
SELECT user_id, event_id, verdict, state FROM s
""",
)
def circuit_breaker(spark, sf_dir):
    from tessera.functions.transitions import BreakerRule

    rule = BreakerRule(timeout=3600.0, should_trip=lambda c: c.failures_in_row >= 2)
    return folds.circuit_breaker(table(spark, sf_dir, "events"), KEY, TS, ID, F.col("event_type") != "error", rule).select(KEY, ID, "verdict", "state")


@query("backoff_exponential", "SELECT n AS retries, least(60.0::DOUBLE, pow(2.0::DOUBLE, n) * 0.5::DOUBLE) AS delay FROM range(21) AS t(n)")
def backoff_exponential(spark, sf_dir):
    return spark.range(21).select(F.col("id").alias("retries"), folds.backoff(F.col("id"), 0.5, 60.0).alias("delay"))


@query("backoff_jitter", "SELECT n AS retries, TRUE AS full_ok, TRUE AS equal_ok, TRUE AS decorrelated_ok FROM range(21) AS t(n)")
def backoff_jitter(spark, sf_dir):
    """Whether each drawn delay is within its strategy's bounds."""
    rows = spark.range(21).select(F.lit("k").alias("key"), F.col("id").alias("retries"))
    e = folds.backoff(F.col("retries"), 0.5, 60.0)
    drawn = folds.backoff_decorrelated(rows, "key", "retries", 0.5, 60.0, 7)
    drawn = drawn.select("retries", "delay", e.alias("e"), folds.backoff_full(F.col("retries"), 0.5, 60.0, 7).alias("full"), folds.backoff_equal(F.col("retries"), 0.5, 60.0, 7).alias("equal"))
    return drawn.select("retries", F.col("full").between(0, F.col("e")).alias("full_ok"), F.col("equal").between(F.col("e") / 2, F.col("e")).alias("equal_ok"), F.col("delay").between(0.5, 60.0).alias("decorrelated_ok"))


@query(
    "token_wait",
    f"""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) * 1000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE user_id IS NOT NULL),
s AS (
  SELECT user_id, event_id, i, t AS last, {BURST - 1}::DOUBLE AS tokens, 0::DOUBLE AS wait FROM e WHERE i = 1
  UNION ALL
  SELECT user_id, event_id, i, CASE WHEN have >= 1 THEN t ELSE last END, CASE WHEN have >= 1 THEN have - 1 ELSE tokens END, CASE WHEN have < 1 THEN trunc(1000000000::DOUBLE * ((1 - have) / {LIMIT}::DOUBLE)) ELSE 0 END
  FROM (SELECT e.*, s.last, s.tokens, least(s.tokens + least(e.t - s.last, trunc(1000000000::DOUBLE * (({BURST} - s.tokens) / {LIMIT}::DOUBLE))) / 1000000000::DOUBLE * {LIMIT}::DOUBLE, {BURST}::DOUBLE) AS have
        FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1))
SELECT user_id, event_id, wait::BIGINT AS wait_ns FROM s
""",
)
def token_wait(spark, sf_dir):
    return folds.token_waits(table(spark, sf_dir, "events"), KEY, TS, ID, LIMIT, BURST).select(KEY, ID, "wait_ns")


DEQUE = ("push_left", "push_right", "push_right", "pop_left", "push_left", "pop_right", "remove")
_OP = f"[{', '.join(repr(o) for o in DEQUE)}][(event_id % {len(DEQUE)})::INT + 1]"


@query(
    "deque_fold",
    f"""
WITH RECURSIVE e AS (SELECT user_id, {_OP} AS op, event_id % 5 AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events WHERE user_id IS NOT NULL),
s AS (
  SELECT user_id, 0::BIGINT AS i, []::BIGINT[] AS items FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL
  SELECT e.user_id, e.i, CASE op WHEN 'push_left' THEN list_prepend(value, items) WHEN 'push_right' THEN list_append(items, value) WHEN 'pop_left' THEN items[2:] WHEN 'pop_right' THEN items[:len(items) - 1]
    ELSE CASE WHEN list_contains(items, value) THEN items[:list_position(items, value) - 1] || items[list_position(items, value) + 1:] ELSE items END END
  FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)
SELECT user_id, array_to_string(arg_max(items, i), ',') AS items FROM s GROUP BY 1
""",
)
def deque_fold(spark, sf_dir):
    """Events as a log of deque operations for each user."""
    ops = F.array(*(F.lit(o) for o in DEQUE))
    log = table(spark, sf_dir, "events").select(KEY, F.col(ID).alias("seq"), F.get(ops, F.pmod("event_id", F.lit(len(DEQUE))).cast("int")).alias("op"), (F.col(ID) % 5).alias("value"))
    return folds.deques(log, KEY, "seq", "op", "value").select(KEY, F.array_join(F.col("items").cast("array<string>"), ",").alias("items"))
