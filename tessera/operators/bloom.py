"""Bloom filters: counting, bitwise and scalable, as tables of cells.

The number of cells m is raised to a power of two of at least 512. An item's
SipHash-2-4 gives k cells: with h its top log2(m) bits and l its lowest,
cell i is ``(h + i l) mod m``. A counting filter is ``idx bigint, cnt int``
(counts stop at 65535), a bit filter ``idx bigint``; both hold non-empty cells
only, so they are built by a partial and a final aggregate and probed by a join
on the cell, whatever their size. Null items are ignored.

A scalable filter opens thousands of small layers. Each one of at most
WHOLE_BITS cells is a bitmap, built and probed in one task; larger ones are bit
filters as above. Probes go by pairs of a block of hashes and a group of layers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, exp, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.hashing import siphash_hash
from tessera.operators.storage import written

LEAST_BITS, MOST_BITS, COUNT_LIMIT = 9, 37, 65535
#: Cells of a layer that one task holds as a bitmap; a larger one is a table of cells.
WHOLE_BITS = 1 << 26
#: Hashes of a block, layers and bytes of a group: what a task holds when it probes. A layer may exceed the bytes alone.
BLOCK, LAYERS, GROUP_BYTES = 1 << 18, 256, 1 << 23
#: Cells that are tested at once; hashes that are sent as one row.
AT_ONCE, ROW = 1 << 16, 1 << 13


def guess(n: int, p: float) -> tuple[int, int]:
    """Cells and hashes for n items at false-positive rate p."""
    return _guess(n, log(p))


def _guess(n: int, log_p: float) -> tuple[int, int]:
    m = ceil(-n * log_p / log(2) ** 2)
    return m, ceil(log(2) * m / n)


def _parts(h: np.ndarray, one: Bloom) -> tuple[np.ndarray, np.ndarray]:
    """Top and lowest bits of unsigned hashes, from which the cells come."""
    return (h >> np.uint64(65 - one.m.bit_length())).astype(np.int64), (h & np.uint64(one.m - 1)).astype(np.int64)


def _all_filled(h: np.ndarray, bits: np.ndarray, one: Bloom) -> np.ndarray:
    """Indices of the unsigned hashes whose cells are all set; a hash goes at its first empty cell."""
    high, low = _parts(h, one)
    left, i = np.arange(len(h)), 0

    def filled(cells: np.ndarray) -> np.ndarray:
        cells &= one.m - 1
        return bits[cells >> 3] >> (cells & 7).astype(np.uint8) & np.uint8(1) != 0

    while i < one.k and len(left) * (one.k - i) > AT_ONCE:
        hit = filled(high + low * i)
        left, high, low, i = left[hit], high[hit], low[hit], i + 1
    if i < one.k and len(left):
        left = left[filled(high[:, None] + low[:, None] * np.arange(i, one.k)).all(axis=1)]
    return left


@dataclass(frozen=True)
class Bloom:
    m: int
    k: int

    def __post_init__(self):
        bits = min(MOST_BITS, max(LEAST_BITS, (max(1, self.m) - 1).bit_length()))
        object.__setattr__(self, "m", 1 << bits)

    @classmethod
    def guess(cls, n: int, p: float) -> Bloom:
        return cls(*guess(n, p))

    def cells_of(self, hash_: Column) -> Column:
        bits, mask = self.m.bit_length() - 1, F.lit(self.m - 1)
        high, low = F.shiftrightunsigned(hash_, 64 - bits), hash_.bitwiseAND(mask)
        return F.array(*((high + low * i).bitwiseAND(mask) for i in range(self.k)))

    def _exploded(self, df: DataFrame, item: str, *keep: str) -> DataFrame:
        hashed = df.filter(F.col(item).isNotNull()).withColumn("_h", siphash_hash(item))
        return hashed.select(*keep, F.explode(self.cells_of(F.col("_h"))).alias("idx"))

    def build(self, df: DataFrame, item: str) -> DataFrame:
        """Counting filter; every row of ``df`` is one addition."""
        by_item = df.filter(F.col(item).isNotNull()).groupBy(F.col(item).cast("string").alias("_i")).count()
        return self._exploded(by_item, "_i", "count").groupBy("idx").agg(F.least(F.sum("count"), F.lit(COUNT_LIMIT)).cast("int").alias("cnt"))

    def build_bits(self, df: DataFrame, item: str) -> DataFrame:
        return self._exploded(df.select(F.col(item).cast("string").alias("_i")).distinct(), "_i").distinct()

    def remove(self, cells: DataFrame, df: DataFrame, item: str) -> DataFrame:
        """The counting filter after one removal for each row of ``df``; items that the filter lacks (judged before the removals) change nothing, saturated cells go down too."""
        present = self.exist(cells, df, item).filter("exist").select(item)
        lost = self._exploded(df.select(F.col(item).cast("string").alias(item)).join(present, item), item).groupBy("idx").count()
        left = cells.join(lost, "idx", "left").select("idx", F.greatest(F.col("cnt") - F.coalesce("count", F.lit(0)), F.lit(0)).cast("int").alias("cnt"))
        return left.filter("cnt > 0")

    def exist(self, cells: DataFrame, items: DataFrame, item: str) -> DataFrame:
        """``item, exist`` for each different item: whether all its cells are filled."""
        asked = items.filter(F.col(item).isNotNull()).select(F.col(item).cast("string").alias(item)).distinct()
        probes = self._exploded(asked, item, item).distinct()
        filled = cells.select("idx", F.lit(1).alias("hit"))
        return probes.join(filled, "idx", "left").groupBy(item).agg((F.count(F.lit(1)) == F.count("hit")).alias("exist"))

    def clear(self, cells: DataFrame) -> DataFrame:
        return cells.filter("false")

    def false_positive(self, n: int) -> float:
        """Rate after n additions; computed with m - 1, the mask of the cells."""
        return (1 - exp(-self.k * n / (self.m - 1))) ** self.k

    def fill_ratio(self, n: int) -> float:
        return 1 - exp(-n / ceil((self.m - 1) / self.k))


@dataclass(frozen=True)
class ScalableBloom:
    """A row of bit filters: a new one, for a smaller rate, follows whenever half of the newest is filled. Which filter an addition goes to depends on its number alone."""

    p: float
    n: int = 10_000
    r: float = 0.8
    fill: float = 0.5

    def layer(self, i: int) -> Bloom:
        rate = self.p * self.r**i
        return Bloom(*_guess(self.n, log(rate) if rate else log(self.p) + i * log(self.r)))  # the rate leaves the range of doubles, its logarithm does not

    def capacity(self, i: int) -> int:
        """Additions that layer i takes before the next one opens."""
        one = self.layer(i)
        return ceil(-log(1 - self.fill) * ceil((one.m - 1) / one.k))

    def bounds(self, additions: int) -> list[int]:
        """First addition number (from 0) of each layer that ``additions`` open."""
        out, at = [0], 0
        while (at := at + self.capacity(len(out) - 1)) < additions:
            out.append(at)
        return out

    def layer_of(self, number: Column, additions: int) -> Column:
        bounds = np.array(self.bounds(additions))

        @F.pandas_udf(T.IntegerType())
        def run(numbers: pd.Series) -> pd.Series:
            return pd.Series(np.maximum(np.searchsorted(bounds, numbers.fillna(0).to_numpy(np.int64), "right") - 1, 0).astype(np.int32))

        return run(number.cast("bigint"))

    def _layers(self, additions: int) -> list[Bloom]:
        return [self.layer(i) for i in range(len(self.bounds(additions)))]

    def build(self, df: DataFrame, item: str, number: str, additions: int) -> DataFrame:
        """``layer, idx, bits`` from rows numbered from 0 by ``number``: a bitmap, or a filled cell of a layer of more than WHOLE_BITS."""
        layers = self._layers(additions)
        rows = df.select(F.col(item).cast("string").alias("_i"), self.layer_of(F.col(number), additions).alias("layer")).filter("_i IS NOT NULL")
        whole = [i for i, one in enumerate(layers) if one.m <= WHOLE_BITS]
        large = [i for i, one in enumerate(layers) if one.m > WHOLE_BITS]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, bits = None, None

            def full() -> pa.RecordBatch:
                data = np.packbits(bits, bitorder="little").tobytes()
                return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([None], pa.int64()), pa.array([data], pa.binary())], names=["layer", "idx", "bits"])

            for batch in batches:
                layer, h = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                start = np.flatnonzero(np.concatenate([[True], layer[1:] != layer[:-1]])) if len(layer) else []
                for a, z in zip(start, np.append(start[1:], len(layer))):
                    one = layers[layer[a]]
                    if layer[a] != now:
                        if now is not None:
                            yield full()
                        now, bits = int(layer[a]), np.zeros(one.m, bool)
                    high, low = _parts(h[a:z].view(np.uint64), one)
                    for i in range(one.k):
                        bits[(high + low * i) & (one.m - 1)] = True
            if now is not None:
                yield full()

        hashed = rows.filter(F.col("layer") <= max(whole, default=-1)).select("layer", siphash_hash("_i").alias("h"))  # layers only grow
        out = hashed.repartition("layer").sortWithinPartitions("layer").mapInArrow(run, "layer int, idx bigint, bits binary")
        for i in large:
            cells = layers[i].build_bits(rows.filter(F.col("layer") == i), "_i")
            out = out.unionByName(cells.select(F.lit(i).alias("layer"), "idx", F.lit(None).cast("binary").alias("bits")))
        return out

    def exist(self, cells: DataFrame, items: DataFrame, item: str, additions: int) -> DataFrame:
        """``item, exist`` for each different item: whether all its cells are filled in some layer."""
        layers = self._layers(additions)
        asked = items.filter(F.col(item).isNotNull()).select(F.col(item).cast("string").alias(item)).distinct()
        asked = written(asked.withColumn("_h", siphash_hash(item)))
        blocks = max(1, -(-asked.count() // BLOCK))
        group, groups, held, bytes_ = [], 0, 0, 0
        for one in layers:
            held, bytes_ = held + 1, bytes_ + (one.m >> 3)
            if held > 1 and (bytes_ > GROUP_BYTES or held > LAYERS):
                groups, held, bytes_ = groups + 1, 1, one.m >> 3
            group.append(groups)
        at = np.array(group)

        @F.pandas_udf(T.IntegerType())
        def group_of(layer: pd.Series) -> pd.Series:
            return pd.Series(at[layer.to_numpy()].astype(np.int32))

        def probe(hashes: pa.Table, filters: pa.Table) -> pa.Table:
            h, found = np.frombuffer(b"".join(hashes["h"].to_pylist()), np.uint64), []
            for layer, bits in zip(filters["layer"].to_pylist(), filters["bits"]):
                hit = _all_filled(h, np.frombuffer(bits.as_buffer(), np.uint8), layers[layer])
                found.append(h[hit])
                h = np.delete(h, hit)
            return pa.table({"h": pa.array(np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64))})

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                block, h = (c.to_numpy() for c in batch.columns)
                for b in np.unique(block):
                    own = h[block == b]
                    rows = [own[i : i + ROW].tobytes() for i in range(0, len(own), ROW)]
                    yield pa.RecordBatch.from_arrays([pa.array([b] * len(rows), pa.int32()), pa.array(rows, pa.binary())], names=["b", "h"])

        different = asked.select(F.col("_h").alias("h")).distinct().select(F.pmod("h", F.lit(blocks)).cast("int").alias("b"), "h")
        sent = different.repartition("b").sortWithinPartitions("b").mapInArrow(packed, "b int, h binary")
        hashes = sent.select("b", "h", F.explode(F.sequence(F.lit(0), F.lit(groups))).alias("g"))
        filters = cells.filter("bits IS NOT NULL").select("layer", "bits", group_of("layer").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
        found = hashes.groupBy("g", "b").cogroup(filters.groupBy("g", "b")).applyInArrow(probe, "h bigint")
        for i, one in enumerate(layers):
            if one.m > WHOLE_BITS:
                hit = one.exist(cells.filter(F.col("layer") == i).select("idx"), asked, item).filter("exist")
                found = found.unionByName(hit.select(siphash_hash(item).alias("h")))
        found = found.distinct().select(F.col("h").alias("_h"), F.lit(True).alias("exist"))
        return asked.join(found, "_h", "left").select(item, F.coalesce("exist", F.lit(False)).alias("exist"))

    def false_positive(self, additions: int) -> float:
        bounds = [*self.bounds(additions), additions]
        miss = 1.0
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            miss *= 1 - self.layer(i).false_positive(b - a)
        return 1 - miss
