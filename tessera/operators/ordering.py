"""Order statistics, global numbering and ordered upsert tables.

Global numbers are found without one task seeing all rows and with one shuffle:
rows are dealt by range, sorted in their partitions, numbered or summed there as
they stream by, and written. Per-partition totals (one row each) are summed on
the driver, and every partition adds its offset.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.storage import written

#: A rank up to this is found by the heap of a top-k; the result does not depend on it.
HEAP = 10_000
#: Beyond it, a k-th value is sought between quantiles this far on either side of its own.
NEAR = 0.001
LEAST = -(1 << 63)
#: Bits of the place in a partition, as monotonically_increasing_id has them.
PLACE_BITS = 33


def sort_values(df: DataFrame, column: str) -> DataFrame:
    """All rows in ascending order of a column, nulls first."""
    return df.orderBy(F.col(column).asc())


def top_k(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k greatest values, without a full sort."""
    return df.orderBy(F.col(column).desc()).limit(k)


def _ranged(df: DataFrame, order: list[Column], within: list[Column]) -> DataFrame:
    """Range partitions, as many as a shuffle has; ties stay in one partition."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *order).sortWithinPartitions(*within)


def _placed(df: DataFrame) -> DataFrame:
    """``df`` with its partition ``_p`` and the place ``_i`` of each row there, fixed by writing it."""
    at = F.monotonically_increasing_id()
    rows = df.withColumn("_at", at).withColumns({"_p": F.shiftright("_at", PLACE_BITS).cast("int"), "_i": F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))})
    return written(rows.drop("_at"), "dealt")


def _by_partition(values: list[int | None]) -> Column:
    """The value of a row's partition, by index from one literal (null where there is none)."""
    text = ",".join("" if v is None else str(v) for v in values)
    return F.get(F.split(F.lit(text), ","), F.col("_p")).try_cast("bigint") if values else F.lit(None).cast("bigint")


def _offsets(totals: dict[int, int]) -> list[int]:
    """The sum of the totals of earlier partitions, by ``_p``."""
    return np.cumsum([0, *(totals.get(p, 0) for p in range(max(totals, default=-1)))]).tolist()


def numbered(df: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """``df`` with dense numbers from 0 in the given total order."""
    columns = [F.col(c) for c in order]
    rows = _placed(_ranged(df, columns, columns))
    before = _offsets({r["_p"]: r["count"] for r in rows.groupBy("_p").count().collect()})
    return rows.withColumn(name, F.col("_i") + _by_partition(before)).drop("_p", "_i")


def prefixes(df: DataFrame, order: list[str], add: Column, top: Column, sums: str, tops: str) -> DataFrame:
    """``df`` with, in the given total order, the sum ``sums`` of ``add`` over all rows before each row, and the greatest ``top - sums`` up to and with it as ``tops`` (null until there is one)."""
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.LongType()) for n in ("_a", "_s", "_m"))])
    columns = [F.col(c) for c in order]
    asked = _ranged(df.withColumns({"_a": F.coalesce(add.cast("bigint"), F.lit(0)), "_t": top.cast("bigint")}), columns, columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, best = 0, LEAST
        for batch in batches:
            added = batch.column("_a").to_numpy(zero_copy_only=False)
            upto = np.cumsum(added) + total
            known = batch.column("_t").is_valid().to_numpy(zero_copy_only=False)
            sums = upto - added
            highest = np.maximum.accumulate(np.where(known, batch.column("_t").fill_null(0).to_numpy(zero_copy_only=False) - sums, LEAST))
            highest = np.maximum(highest, best)
            if len(batch):
                total, best = int(upto[-1]), int(highest[-1])
            kept = [batch.column(f.name) for f in schema.fields[:-2]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sums), pa.array(highest, mask=highest == LEAST)], names=schema.names)

    rows = _placed(asked.mapInArrow(run, schema))
    found = rows.groupBy("_p").agg(F.max_by(F.col("_s") + F.col("_a"), "_i").alias("s"), F.max("_m").alias("m")).collect()
    ahead, greatest = _offsets({r["_p"]: r.s for r in found}), {r["_p"]: r.m for r in found}
    earlier, best = [], None
    for p, at in enumerate(ahead):
        earlier.append(best)
        here = greatest.get(p)
        best = max((x for x in (best, None if here is None else here - at) if x is not None), default=None)
    offset = _by_partition(ahead)
    return rows.withColumns({sums: F.col("_s") + offset, tops: F.greatest(F.col("_m") - offset, _by_partition(earlier))}).drop(*({"_p", "_i", "_a", "_s", "_m"} - {sums, tops}))


def running_sum(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before it in the given total order."""
    return prefixes(df, order, value, F.lit(None), name, "_top").drop("_top")


def running_max(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with the greatest ``value`` up to and with each row in the given total order."""
    return prefixes(df, order, F.lit(0), value, "_sum", name).drop("_sum")


def _between(values: DataFrame, k: int) -> DataFrame | None:
    """The k-th smallest of the column ``value`` from the rows near its quantile alone: scans, and a shuffle of about NEAR of the rows. None where quantiles do not enclose it."""
    n = values.count()
    if n < k:
        return values.limit(0)
    near = F.percentile_approx("value", F.array(F.lit(max(0.0, k / n - NEAR)), F.lit(min(1.0, k / n + NEAR))), F.lit(int(2 / NEAR)))
    low, high = values.agg(near.alias("q")).first().q
    low, high = F.lit(low).cast(values.schema["value"].dataType), F.lit(high).cast(values.schema["value"].dataType)
    inside = F.col("value").between(low, high)
    below, found = values.agg(F.count_if(F.col("value") < low), F.count_if(inside)).first()
    return _ranked(values.filter(inside), k - below) if below < k <= below + found else None


def _ranked(values: DataFrame, k: int) -> DataFrame:
    """Equal values are counted before they are put in order."""
    below = running_sum(values.groupBy("value").count(), ["value"], F.col("count"), "below")
    return below.filter((F.col("below") < k) & (F.col("below") + F.col("count") >= k)).select("value")


def kth_smallest(df: DataFrame, column: str, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The k-th smallest (from 1) non-null value, of each group if ``by`` is given; groups with fewer have none.

    Without groups, a small rank takes the heap of a top-k. A greater one is
    enclosed by two approximate quantiles, the rows below are counted, and only
    those between are put in order; types without quantiles are ordered whole.
    With groups, equal values are counted before they are put in order, so a
    group's window has a row per different value.
    """
    if k < 1:
        raise ValueError("k counts from 1")
    if by:
        counts = df.filter(F.col(column).isNotNull()).groupBy(*by, column).count()
        upto = F.sum("count").over(Window.partitionBy(*by).orderBy(column).rowsBetween(Window.unboundedPreceding, 0))
        return counts.withColumn("_upto", upto).filter(F.col("_upto") >= k).groupBy(*by).agg(F.min(column).alias("value"))
    values = df.filter(F.col(column).isNotNull()).select(F.col(column).alias("value"))
    if k <= HEAP:
        return values.orderBy("value").limit(k).agg(F.max("value").alias("value"), F.count("*").alias("n")).filter(F.col("n") == k).select("value")
    if isinstance(values.schema["value"].dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        found = _between(values, k)
        if found is not None:
            return found
    return _ranked(values, k)


def ordered_upsert(log: DataFrame, key: str, value: str, seq: str, op: str | None = None, removal: str = "remove") -> DataFrame:
    """``key, value`` after a change log: the last change of a key by ``seq`` holds; removed keys are absent."""
    last = F.max_by(F.struct(F.col(value).alias("value"), (F.col(op) if op else F.lit("set")).alias("op")), seq)
    return log.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(last.alias("last")).filter(F.col("last.op") != removal).select("key", "last.value")


def get(table: DataFrame, key) -> DataFrame:
    return table.filter(F.col("key") == key)


def front(table: DataFrame) -> DataFrame:
    """The row of the least key."""
    return table.agg(F.min(F.struct("key", "value")).alias("r")).filter("r IS NOT NULL").select("r.*")


def key_range(table: DataFrame, low, high) -> DataFrame:
    """Rows of low <= key < high in order of key."""
    return table.filter((F.col("key") >= low) & (F.col("key") < high)).orderBy("key")


def ordered_scan(table: DataFrame, key: str = "key") -> DataFrame:
    """Each row with the key that follows it, null at the end, without gathering all keys in one task."""
    kind = table.schema[key].dataType
    schema = T.StructType([*table.schema.fields, T.StructField("next_key", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after = None  # rows come from the greatest key down, so the key after a row is the one before it here
        for batch in batches:
            if len(batch):
                keys = batch.column(key)
                first = pa.nulls(1, keys.type) if after is None else after
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.concat_arrays([first, keys.slice(0, len(keys) - 1)])], names=schema.names)
                after = keys.slice(len(keys) - 1)

    rows = _placed(_ranged(table, [F.col(key)], [F.col(key).desc()]).mapInArrow(run, schema))
    firsts = {r["_p"]: r.k for r in rows.groupBy("_p").agg(F.min(key).alias("k")).collect()}
    beyond, following = [], None
    for p in range(max(firsts, default=-1), -1, -1):
        beyond.append(F.lit(following).cast(kind))
        following = firsts.get(p, following)
    after = F.get(F.array(*reversed(beyond)), F.col("_p")) if beyond else F.lit(None).cast(kind)
    return rows.withColumn("next_key", F.coalesce("next_key", after)).drop("_p", "_i")
