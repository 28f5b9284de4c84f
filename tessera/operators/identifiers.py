"""Sequence numbers for rows in a given total order."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordering import numbered, prefixes, running_sum

#: Start of flake ids where none is given.
FLAKE_START = datetime(2019, 10, 9, tzinfo=timezone.utc)
FLAKE_BITS, FLAKE_LEAST, FLAKE_MOST = 18, 10, 21


def dense_ids(df: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """Numbers from 0 without gaps."""
    return numbered(df, order, name)


def _asked(n: str) -> Column:
    return F.when(F.col(n) >= 1, F.col(n)).otherwise(F.raise_error(F.lit("n must be positive")).cast("bigint"))


def reserved_ids(df: DataFrame, order: list[str], n: str, name: str = "id") -> DataFrame:
    """The first of the ``n`` numbers that each row reserves; rows that ask for fewer than one fail the query."""
    return running_sum(df, order, _asked(n), name)


def flake_bits(bits: int) -> int:
    return bits if FLAKE_LEAST <= bits <= FLAKE_MOST else FLAKE_BITS


def _elapsed(ts: str, start: datetime) -> Column:
    """Whole seconds since the start, in milliseconds."""
    if start.timestamp() < 0 or start > datetime.now(timezone.utc):
        raise ValueError("the start is before 1970 or still to come")
    return (F.unix_seconds(F.col(ts).cast("timestamp")) - int(start.timestamp())) * 1000


def flake_ids(df: DataFrame, order: list[str], ts: str, start: datetime = FLAKE_START, bits: int = FLAKE_BITS, name: str = "id") -> DataFrame:
    """Ids of elapsed time (whole seconds, in milliseconds) and a sequence in the low bits: each is the greater of its time's first id and the id before it plus one.

    The recurrence e(i) = max(t(i), e(i-1) + 1) is the running maximum of t(i) - i, plus i.
    """
    return flake_ranges(df, order, ts, None, start, bits, name)


def flake_ranges(df: DataFrame, order: list[str], ts: str, n: str | None, start: datetime = FLAKE_START, bits: int = FLAKE_BITS, name: str = "id") -> DataFrame:
    """The first of the ``n`` ids that each row reserves, as :func:`flake_ids`; rows that ask for fewer than one fail the query.

    With s(i) the ids reserved before row i, e(i) = max(t(i), e(i-1) + n(i-1)) is the running maximum of t(i) - s(i), plus s(i).
    """
    first = F.shiftleft(_elapsed(ts, start), flake_bits(bits))
    counted = prefixes(df, order, F.lit(1) if n is None else _asked(n), first, "_before", "_ahead")
    return counted.withColumn(name, F.col("_ahead") + F.col("_before")).drop("_before", "_ahead")


def flake_parts(id_: Column, bits: int = FLAKE_BITS) -> Column:
    """STRUCT(elapsed_ms, sequence) of a flake id."""
    bits = flake_bits(bits)
    return F.struct(F.shiftright(id_, bits).alias("elapsed_ms"), id_.bitwiseAND(F.lit((1 << bits) - 1)).alias("sequence"))
