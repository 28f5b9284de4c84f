"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.storage import cut



def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo")), F.bit_xor("hi")).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b`` long) but the roots; a root is the smallest node of its component.

    Every step moves each node's links to its smallest neighbour, so links per
    node stay few; a hub is reduced by a partial minimum before it is shuffled.
    Steps are kept in the shared folder, which also cuts their lineage. Nulls
    and loops are ignored; an empty table gives an empty result.
    """
    at_once = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("a != b").distinct()
    at, state = cut(at_once), None
    while state != (now := _state(at)):
        state = now
        if not state[0]:
            break
        both = at.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(at.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(lowest, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).filter("hi != lo")
        at = cut(moved.union(lowest.select("hi", F.col("m").alias("lo"))).distinct())
    return at.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
