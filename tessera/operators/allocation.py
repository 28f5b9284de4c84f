"""Dominant-resource fair allocation."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SaturatedError(Exception):
    """The node of least share no longer fits."""


class FairAllocator:
    """Tasks go one by one to the node of the lowest dominant share, first come first among equals, until that node no longer fits."""

    def __init__(self, resources: dict[str, float], demands: dict[str, dict[str, float]]):
        if not resources:
            raise ValueError("no resources")
        if not demands:
            raise ValueError("no nodes")
        self.resources, self.consumed = dict(resources), dict.fromkeys(resources, 0.0)
        self.demands, self.allocated, self.share, self.tasks = {}, {}, {}, {}
        self.heap: list[tuple[float, int, str]] = []
        self.added = 0
        for node, demand in demands.items():
            self.add_node(node, demand)

    def add_node(self, node: str, demand: dict[str, float]) -> None:
        self.demands[node], self.allocated[node], self.share[node], self.tasks[node] = dict(demand), dict.fromkeys(demand, 0.0), 0.0, 0
        heapq.heappush(self.heap, (0.0, self.added, node))
        self.added += 1

    def remove_node(self, node: str) -> None:
        """The node gets no more tasks; what it has stays consumed."""
        self.heap = [x for x in self.heap if x[2] != node]
        heapq.heapify(self.heap)

    def update_demand(self, node: str, delta: dict[str, float]) -> None:
        for k, v in delta.items():
            self.demands[node][k] = self.demands[node].get(k, 0.0) + v

    def update_resource(self, delta: dict[str, float]) -> None:
        for k, v in delta.items():
            self.resources[k] = self.resources.get(k, 0.0) + v

    def next_task(self) -> str:
        if not self.heap:
            raise ValueError("no nodes")
        _, order, node = self.heap[0]
        demand = self.demands[node]
        if any(self.consumed.get(k, 0.0) + v > self.resources.get(k, 0.0) for k, v in demand.items()):
            raise SaturatedError(node)
        for k, v in demand.items():
            self.allocated[node][k] = self.allocated[node].get(k, 0.0) + v
            self.consumed[k] = self.consumed.get(k, 0.0) + v
        shares = [self.allocated[node][k] / self.resources[k] for k in self.allocated[node] if self.resources.get(k, 0.0) > 0]
        self.share[node] = max([self.share[node], *shares])
        self.tasks[node] += 1
        heapq.heapreplace(self.heap, (self.share[node], order, node))
        return node

    def run(self) -> dict[str, int]:
        """Tasks by node when nothing more fits. Nodes without demand would never end it and are refused."""
        if any(not any(v > 0 for v in d.values()) for d in self.demands.values()):
            raise ValueError("a node demands nothing")
        try:
            while True:
                self.next_task()
        except SaturatedError:
            return self.tasks


def allocate(demands: DataFrame, resources: DataFrame, cluster: str = "cluster") -> DataFrame:
    """``cluster, node, tasks, share``: the allocation of each cluster at saturation.

    ``demands`` is ``cluster, node, demand map<string,double>``; ``resources`` is
    ``cluster, resource map<string,double>``. Nodes count in order of name.
    """
    joined = demands.join(resources, cluster).select(cluster, "node", F.map_entries("demand").alias("demand"), F.map_entries("resource").alias("resource"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", kind="stable")
        plain = lambda entries: {e["key"]: float(e["value"]) for e in entries}
        one = FairAllocator(plain(pdf["resource"].iloc[0]), {n: plain(d) for n, d in zip(pdf["node"], pdf["demand"])})
        one.run()
        return pd.DataFrame({cluster: pdf[cluster].iloc[0], "node": list(one.tasks), "tasks": list(one.tasks.values()), "share": [one.share[n] for n in one.tasks]})

    schema = T.StructType([demands.schema[cluster], T.StructField("node", T.StringType()), T.StructField("tasks", T.LongType()), T.StructField("share", T.DoubleType())])
    return joined.groupBy(cluster).applyInPandas(run, schema)
