"""HyperLogLog sketches as tables of registers.

A sketch is ``reg bigint, rho int`` (with any group columns) of its non-zero
registers, so building and merging are plain maxima. An item's FNV-1 32-bit
hash gives the register in its top b bits and rho as one more than its trailing
zeros, at most 33 - b. Null items are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.hashing import fnv1_32_hash


@dataclass(frozen=True)
class HyperLogLog:
    registers: int
    hash_: Callable[[Column], Column] = fnv1_32_hash

    def __post_init__(self):
        if self.registers < 1:
            raise ValueError("registers must be positive")
        object.__setattr__(self, "registers", 1 << max(0, (self.registers - 1).bit_length()))

    @classmethod
    def guess(cls, standard_error: float) -> HyperLogLog:
        return cls(1 << ceil(log2((1.04 / standard_error) ** 2)))

    @property
    def bits(self) -> int:
        return self.registers.bit_length() - 1

    @property
    def alpha(self) -> float:
        return {16: 0.673, 32: 0.697, 64: 0.709}.get(self.registers, 0.7213 / (1 + 1.079 / self.registers))

    def build(self, df: DataFrame, item: str, by: tuple[str, ...] = ()) -> DataFrame:
        items = df.filter(F.col(item).isNotNull()).select(*by, F.col(item).cast("string").alias("item")).distinct()
        h = self.hash_(F.col("item"))
        zeros = F.when(F.col("h") == 0, F.lit(64)).otherwise(F.bit_count(F.col("h").bitwiseAND(-F.col("h")) - 1))
        rho = F.least(zeros + 1, F.lit(33 - self.bits)).cast("int")
        return items.withColumn("h", h).select(*by, F.shiftright("h", 32 - self.bits).alias("reg"), rho.alias("rho")).groupBy(*by, "reg").agg(F.max("rho").alias("rho")).withMetadata("rho", {"registers": self.registers})

    def reset(self, sketch: DataFrame) -> DataFrame:
        return sketch.filter("false")

    def merge(self, *sketches: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
        """Of sketches with this number of registers (one that was built with another is refused) and the same hash; also drops group columns not in ``by``."""
        for one in sketches:
            if (found := one.schema["rho"].metadata) and found != {"registers": self.registers}:
                raise ValueError(f"a sketch of {found} does not merge into {self.registers} registers")
        out = sketches[0].select(*by, "reg", "rho")
        for other in sketches[1:]:
            out = out.unionByName(other.select(*by, "reg", "rho"))
        return out.groupBy(*by, "reg").agg(F.max("rho").alias("rho")).withMetadata("rho", {"registers": self.registers})

    def estimate(self, sketch: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
        """``by, estimate``: with the corrections for small and large ranges, cut to an integer."""
        m = float(self.registers)
        sums = sketch.groupBy(*by).agg(F.sum(F.pow(F.lit(2.0), -F.col("rho"))).alias("s"), F.count(F.lit(1)).alias("n"))
        empty = F.lit(m) - F.col("n")
        raw = F.lit(self.alpha * m * m) / (empty + F.coalesce("s", F.lit(0.0)))
        small = F.when(empty > 0, F.lit(m) * F.log(F.lit(m) / empty)).otherwise(raw)
        top = float(1 << 32)
        large = F.lit(-top) * F.log(1 - raw / top)
        return sums.select(*by, F.when(raw <= 2.5 * m, small).when(raw > top / 30, large).otherwise(raw).cast("bigint").alias("estimate"))
