"""Count-Min sketches as tables of cells.

A sketch is a DataFrame ``row int, col bigint, cnt bigint`` of its non-empty
cells, so building one is a partial and a final sum, and merging is a union and
a sum. A key is hashed once (FNV-1, 64 bits); its column in row i is
``(low + high * i) mod width`` of the hash's 32-bit halves. Null keys are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, e, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.hashing import fnv1_64_hash


@dataclass(frozen=True)
class CountMin:
    width: int
    depth: int

    def __post_init__(self):
        if self.width < 1 or self.depth < 1:
            raise ValueError("width and depth must be positive")

    @classmethod
    def guess(cls, epsilon: float, delta: float) -> CountMin:
        """Dimensions for an error of epsilon times the total with probability delta."""
        if not (0 < epsilon < 1 and 0 < delta < 1):
            raise ValueError("epsilon and delta must be between 0 and 1")
        return cls(ceil(e / epsilon), ceil(log(1 - delta) / log(0.5)))

    def cells_of(self, hash_: Column) -> Column:
        """Array of structs ``row, col`` of a hash (BIGINT bit pattern)."""
        low, high = hash_.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(hash_, 32)
        return F.array(*(F.struct(F.lit(i).alias("row"), ((low + high * i) % self.width).alias("col")) for i in range(self.depth)))

    def build(self, df: DataFrame, key: str, count: Column | None = None) -> DataFrame:
        """The sketch of a column; counts are summed by key first, so each different key is hashed once."""
        weight = F.lit(1) if count is None else count
        by_key = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("key")).agg(F.sum(weight).cast("bigint").alias("cnt"))
        cells = by_key.select(fnv1_64_hash("key").alias("h"), "cnt").select(F.explode(self.cells_of(F.col("h"))).alias("cell"), "cnt")
        return self._marked(cells.groupBy("cell.row", "cell.col").agg(F.sum("cnt").alias("cnt")))

    def _marked(self, sketch: DataFrame) -> DataFrame:
        return sketch.withMetadata("cnt", {"width": self.width, "depth": self.depth})

    def merge(self, *sketches: DataFrame) -> DataFrame:
        """Of sketches of these dimensions; a sketch that was built with others is refused."""
        for one in sketches:
            if (found := one.schema["cnt"].metadata) and found != {"width": self.width, "depth": self.depth}:
                raise ValueError(f"a sketch of {found} does not merge into {self}")
        out = sketches[0]
        for other in sketches[1:]:
            out = out.unionByName(other)
        return self._marked(out.groupBy("row", "col").agg(F.sum("cnt").alias("cnt")))

    def estimate(self, sketch: DataFrame, keys: DataFrame, key: str) -> DataFrame:
        """``key, estimate`` for each different key: the least of its cells, never below its true count."""
        asked = keys.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias(key)).distinct()
        probes = asked.withColumn("h", fnv1_64_hash(key)).select(key, F.explode(self.cells_of(F.col("h"))).alias("cell")).select(key, "cell.row", "cell.col")
        met = probes.join(sketch, ["row", "col"], "left")
        return met.groupBy(key).agg(F.min(F.coalesce("cnt", F.lit(0))).alias("estimate"))

    def count(self, sketch: DataFrame) -> DataFrame:
        """Sum of all counts: any row of cells holds it."""
        return sketch.filter("row = 0").agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("count"))

    def reset(self, sketch: DataFrame) -> DataFrame:
        return sketch.filter("false")
