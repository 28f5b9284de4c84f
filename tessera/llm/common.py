"""What the training-data operators share: tables, shared storage, word rules."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import cache
from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
#: Bytes of an Arrow batch, unless one row is larger.
BATCH_BYTES = 4 << 20
#: ASCII upper case and its lower case, for languages' texts that must keep other letters.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _trim() -> Callable | None:
    with suppress(AttributeError, OSError, TypeError):  # only the GNU library has it
        return ctypes.CDLL(None).malloc_trim


def give_back() -> None:
    """Returns the process's free memory to the machine: workers live on after a task, beside those of later stages."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def tidied(function: Callable) -> Callable:
    """The same function of batches, which leaves no free memory behind."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from function(batches)
        finally:
            give_back()

    return run


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` on batches of bounded bytes: long texts must not make a batch of a set number of rows grow."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(tidied(function), schema)


def numbers(values: list, kind: str = "bigint") -> Column:
    """A constant array, however long, as one literal."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def bucket_of(value: Column, bounds: list, kind: str = "bigint") -> Column:
    """How many of the sorted bounds are at most the value, by two short scans (of about the root of their number) instead of a long one."""
    if not bounds:
        return F.lit(0)
    group = isqrt(len(bounds)) + 1
    tops = bounds[group - 1 :: group]
    whole = F.size(F.filter(numbers(tops, kind), lambda x: x <= value)) if tops else F.lit(0)
    inner = F.slice(numbers(bounds, kind), whole * group + 1, F.lit(group))
    return (whole * group + F.size(F.filter(inner, lambda x: x <= value))).cast("int")


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def word_count(text: Column) -> Column:
    """Number of words; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def local_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small driver-made table as a local relation, so that its size is known when a join is planned."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_schema(_parse_datatype_string(schema))
    columns = [pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(kind)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=kind), schema=schema)
