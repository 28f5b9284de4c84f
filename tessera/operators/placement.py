"""Placing keys on nodes: hash rings with and without load bounds, lanes, subsets."""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.hashing import crc64, crc64_hash
from tessera.operators.folds import in_turn

REPLICAS, BALANCE = 10, 1.25
#: The ring must be small enough to go to every task: nodes times replicas.
MOST_POINTS = 1 << 20


def ring(nodes: DataFrame, node: str = "node", replicas: int = REPLICAS) -> DataFrame:
    """``point bigint (bit pattern), node``: the hashes of each different node's name and replica number. Of nodes that share a point the greatest name holds it."""
    names = nodes.filter(F.col(node).isNotNull()).select(F.col(node).alias("node")).distinct()
    virtual = names.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))))
    return virtual.select(crc64_hash(F.concat("node", F.col("i").cast("string"))).alias("point"), "node").groupBy("point").agg(F.max("node").alias("node"))


class RingLookup:
    """The ring in memory: sorted unsigned points and their nodes."""

    def __init__(self, points: DataFrame):
        rows = points.limit(MOST_POINTS + 1).collect()
        if len(rows) > MOST_POINTS:
            raise ValueError(f"a ring has at most {MOST_POINTS} points")
        if not rows:
            raise ValueError("no node added")
        self.points = np.array([r.point for r in rows], np.int64).view(np.uint64)
        order = np.argsort(self.points)
        self.points, self.nodes = self.points[order], np.array([r.node for r in rows], object)[order]

    def at(self, hashes: np.ndarray) -> np.ndarray:
        """Index of the first point at or after each hash, around the ring."""
        found = np.searchsorted(self.points, hashes)
        return np.where(found == len(self.points), 0, found)

    def node_of(self, key: Column | str) -> Column:
        """The node of a string key; null for null."""

        @F.pandas_udf(T.StringType())
        def run(keys: pd.Series) -> pd.Series:
            known = keys.notna()
            out = pd.Series([None] * len(keys), index=keys.index, dtype=object)
            if known.any():
                out[known] = self.nodes[self.at(crc64([k.encode() for k in keys[known]]))]
            return out

        return run(F.col(key) if isinstance(key, str) else key)


def max_load(total: int, nodes: int, balance: float = BALANCE) -> int:
    """Load that one node may have: the mean (whole, at least 1) times the balance, rounded up."""
    return ceil(max(1, max(1, total) // nodes) * balance)


class BoundedRing:
    """Placements in sequence: each goes to the first node from its hash on whose load stays within the bound. For one group of keys, in order."""

    def __init__(self, nodes: list[str], replicas: int = REPLICAS, balance: float = BALANCE):
        self.balance, self.load = balance, dict.fromkeys(sorted(set(nodes)), 0)
        held = {}
        names = list(self.load)
        for name in names:
            for h in crc64([f"{name}{i}".encode() for i in range(replicas)]):
                held[int(h)] = name
        self.points = np.array(sorted(held), np.uint64)
        self.nodes = [held[int(p)] for p in self.points]

    @property
    def total(self) -> int:
        return sum(self.load.values())

    def fits(self, node: str) -> bool:
        return self.load[node] + 1 <= max_load(self.total + 1, len(self.load), self.balance)

    def least(self, key: str) -> str:
        """Raises only if every node is full."""
        if not self.nodes:
            raise ValueError("no node added")
        start = int(np.searchsorted(self.points, crc64([key.encode()])[0]))
        for i in range(len(self.nodes)):
            node = self.nodes[(start + i) % len(self.nodes)]
            if self.fits(node):
                return node
        raise ValueError("every node is full")

    def place(self, key: str) -> str:
        node = self.least(key)
        self.load[node] += 1
        return node


def place_bounded(keys: DataFrame, key: str, seq: str, nodes: list[str], group: str, balance: float = BALANCE) -> DataFrame:
    """``group, key, seq, node``: keys of each group placed one after another by ``seq``. A group's rows are one task's stream, since each placement depends on those before it; it holds the loads alone."""

    def advance(one, k):
        return one, one.place(k)

    placed = keys.filter(F.col(key).isNotNull()).select(group, key, seq)
    return in_turn(placed, group, [seq, key], lambda g: BoundedRing(nodes, balance=balance), advance, [key], node=T.StringType())


def loads(deltas: DataFrame, node: str = "node", delta: str = "delta") -> DataFrame:
    """``node, load`` from changes of load."""
    return deltas.groupBy(F.col(node).alias("node")).agg(F.sum(delta).cast("bigint").alias("load"))


def remove_nodes(points: DataFrame, gone: DataFrame) -> DataFrame:
    return points.join(gone.select("node"), "node", "left_anti")


def subsets(backends: DataFrame, clients: DataFrame, size: int, backend: str = "backend", client: str = "client") -> DataFrame:
    """``client, backend``: clients of one round (as many as there are whole subsets) get disjoint subsets of a list that is shuffled anew for each round. Left-over backends are not used.

    The shuffle orders by the MD5 of round and backend. Rounds are as many as clients divided by the subsets of one, so the
    shuffled lists have about as many rows as the result. The list goes to every task; it has at most MOST_POINTS backends.
    """
    n = backends.count()
    if size < 1 or size > n:
        raise ValueError("a subset has from one to all backends")
    if n > MOST_POINTS:
        raise ValueError(f"a list has at most {MOST_POINTS} backends")
    count = n // size
    rounds = clients.filter(F.col(client).isNotNull()).select(F.col(client).alias("client"), F.floor(F.col(client) / count).cast("bigint").alias("round"), F.pmod(F.col(client), F.lit(count)).alias("part"))
    each = rounds.select("round").distinct().join(F.broadcast(backends.select(F.col(backend).alias("backend")).withColumn("_all", F.lit(1))), F.col("_all") == 1)
    place = F.row_number().over(Window.partitionBy("round").orderBy(F.md5(F.concat_ws(":", F.col("round").cast("string"), F.col("backend")).cast("binary")), "backend")) - 1
    shuffled = each.withColumn("part", F.floor(place / size)).select("round", "part", "backend")
    return rounds.join(shuffled, ["round", "part"]).select("client", "backend")


def round_robin_lane(number: Column, lanes: int) -> Column:
    """Lanes in turn for numbered rows; the number of lanes is raised to a power of two."""
    return number.bitwiseAND(F.lit((1 << (lanes - 1).bit_length()) - 1)).cast("int")


def explicit_lane(lane: Column, lanes: int) -> Column:
    return lane.bitwiseAND(F.lit((1 << (lanes - 1).bit_length()) - 1)).cast("int")


