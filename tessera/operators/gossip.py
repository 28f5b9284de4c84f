"""Averages by gossip (push-sum)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordering import numbered
from tessera.operators.storage import cut

THRESHOLD, STEADY, EVERY = 1e-10, 3, 8


def push_sum(readings: DataFrame, node: str, value: str, rounds: int = 60, threshold: float = THRESHOLD, active: str | None = None) -> DataFrame:
    """``node, estimate, steady``: each node's estimate of the average after gossip.

    In a round every node keeps half of its value and weight and sends half to
    one other node, chosen by a hash of its number and the round; what is sent
    is summed by receiver, so mass is conserved. A node that is not active
    forwards all it gets. ``steady`` counts the rounds in a row in which the
    estimate changed by at most ``threshold``; the loop ends early when all have
    STEADY of them. Lineage is cut every EVERY rounds in the shared folder.
    """
    numbers = readings.filter(F.col(node).isNotNull()).groupBy(F.col(node).alias("node")).agg(F.first(value).cast("double").alias("value"), (F.bool_and(active) if active else F.lit(True)).alias("active"))
    numbers = numbered(numbers, ["node"], "i").withColumn("i", F.col("i").cast("int"))
    n = numbers.count()
    if n < 2:
        return numbers.select("node", F.col("value").alias("estimate"), F.lit(0).alias("steady"))
    at = numbers.select("node", "i", "active", "value", F.lit(1.0).alias("weight"), F.lit(0).alias("steady"))
    at = cut(at)
    for step in range(rounds):
        peer = F.pmod(F.col("i") + 1 + F.pmod(F.xxhash64("i", F.lit(step)), F.lit(n - 1)), F.lit(n)).cast("int")
        kept = F.when(F.col("active"), F.lit(0.5)).otherwise(F.lit(0.0))
        # each node sends to itself too, and what it knows of itself goes along
        own = F.struct("node", "active", F.try_divide("value", "weight").alias("before"), "steady")
        sent = F.array(F.struct(F.col("i"), kept.alias("f"), own.alias("own")), F.struct(peer.alias("i"), (1 - kept).alias("f"), F.lit(None).alias("own")))
        parts = at.select(F.explode(sent).alias("p"), "value", "weight")
        sums = parts.groupBy(F.col("p.i").alias("i")).agg(F.max("p.own").alias("own"), F.sum(F.col("p.f") * F.col("value")).alias("value"), F.sum(F.col("p.f") * F.col("weight")).alias("weight"))
        moved = F.abs(F.try_divide("value", "weight") - F.col("own.before"))
        at = sums.select("own.node", "i", "own.active", "value", "weight", F.when(moved <= threshold, F.col("own.steady") + 1).otherwise(0).alias("steady"))
        if step % EVERY == EVERY - 1:
            at = cut(at)
            if not at.filter(F.col("active") & (F.col("steady") < STEADY)).take(1):
                break
    return at.select("node", F.try_divide("value", "weight").alias("estimate"), "steady")


def average(readings: DataFrame, value: str) -> DataFrame:
    """What gossip converges to."""
    return readings.agg(F.avg(value).alias("estimate"))
