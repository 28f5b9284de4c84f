"""Hashes whose exact values matter: FNV-1, CRC-64/ECMA, SipHash-2-4 and jump hash.

Each is a numpy kernel that runs over a whole Arrow batch, one byte position at
a time, and a column function around it. 64-bit results are BIGINT bit
patterns; :func:`unsigned` gives their value as DECIMAL(20,0).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

U = np.uint64
#: Published constants of the hashes.
FNV32_OFFSET, FNV32_PRIME = 2166136261, 16777619
FNV64_OFFSET, FNV64_PRIME = 14695981039346656037, 1099511628211
CRC64_ECMA = 0xC96C5795D7870F42  # reflected polynomial
JUMP_MULTIPLIER = 2862933555777941757
SIP_KEY = b"0123456789ABCDEF"
SIP_START = (0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573)
TWO64 = 1 << 64


def _matrix(items: list[bytes], pad: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The items as rows of bytes, zero-padded, and their lengths."""
    sizes = np.fromiter(map(len, items), np.int64, len(items))
    width = int(sizes.max(initial=0)) + pad
    out = np.zeros((len(items), width), np.uint8)
    flat = np.frombuffer(b"".join(items), np.uint8)
    at = np.repeat(np.arange(len(items)), sizes)
    start = np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[at, np.arange(len(flat)) - start] = flat
    return out, sizes


def _like_lengths(kernel: Callable[[list[bytes]], np.ndarray]) -> Callable[[list[bytes]], np.ndarray]:
    """The kernel over items of like length at a time, so that one long item does not pad all others."""

    def run(items: list[bytes], *args) -> np.ndarray:
        size = np.fromiter((len(x).bit_length() for x in items), np.int64, len(items))
        kinds = np.unique(np.maximum(size, 6))
        if len(kinds) < 2:
            return kernel(items, *args)
        out = np.zeros(len(items), U)
        for kind in kinds:
            own = np.flatnonzero(np.maximum(size, 6) == kind)
            out[own] = kernel([items[i] for i in own], *args)
        return out

    return run


@_like_lengths
def fnv1_64(items: list[bytes]) -> np.ndarray:
    data, sizes = _matrix(items)
    h = np.full(len(items), FNV64_OFFSET, U)
    for i in range(data.shape[1]):
        h = np.where(i < sizes, (h * U(FNV64_PRIME)) ^ data[:, i].astype(U), h)
    return h


@_like_lengths
def fnv1_32(items: list[bytes]) -> np.ndarray:
    data, sizes = _matrix(items)
    h = np.full(len(items), FNV32_OFFSET, np.uint32)
    for i in range(data.shape[1]):
        h = np.where(i < sizes, (h * np.uint32(FNV32_PRIME)) ^ data[:, i], h)
    return h.astype(U)


def _crc_table() -> np.ndarray:
    row = np.arange(256, dtype=U)
    for _ in range(8):
        row = np.where(row & U(1), (row >> U(1)) ^ U(CRC64_ECMA), row >> U(1))
    return row


_CRC = _crc_table()


@_like_lengths
def crc64(items: list[bytes]) -> np.ndarray:
    data, sizes = _matrix(items)
    c = np.full(len(items), TWO64 - 1, U)
    for i in range(data.shape[1]):
        c = np.where(i < sizes, _CRC[(c ^ data[:, i]) & U(255)] ^ (c >> U(8)), c)
    return ~c


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << U(by)) | (x >> U(64 - by))


@_like_lengths
def siphash24(items: list[bytes], key: bytes = SIP_KEY) -> np.ndarray:
    """SipHash with two rounds a block and four at the end."""
    data, sizes = _matrix(items, 8)
    k = np.frombuffer(key, "<u8")
    v = [np.full(len(items), start, U) ^ k[i % 2] for i, start in enumerate(SIP_START)]

    def rounds(state: list[np.ndarray], times: int) -> list[np.ndarray]:
        a, b, c, d = state
        for _ in range(times):
            a, c = a + b, c + d
            b, d = _turn(b, 13) ^ a, _turn(d, 16) ^ c
            a, c = _turn(a, 32) + d, c + b
            d, b = _turn(d, 21) ^ a, _turn(b, 17) ^ c
            c = _turn(c, 32)
        return [a, b, c, d]

    whole = sizes // 8
    for i in range(int(whole.max(initial=0)) + 1):
        m = np.ascontiguousarray(data[:, 8 * i : 8 * i + 8]).view("<u8")[:, 0] if data.shape[1] >= 8 * i + 8 else np.zeros(len(items), U)
        if data.shape[1] < 8 * i + 8:
            for j in range(8 * i, data.shape[1]):
                m |= data[:, j].astype(U) << U(8 * (j - 8 * i))
        last = whole == i
        m = np.where(last, m | ((sizes & 255).astype(U) << U(56)), m)
        mixed = rounds([v[0], v[1], v[2], v[3] ^ m], 2)
        mixed[0] = mixed[0] ^ m
        live = i <= whole
        v = [np.where(live, new, old) for new, old in zip(mixed, v)]
    v[2] = v[2] ^ U(255)
    a, b, c, d = rounds(v, 4)
    return a ^ b ^ c ^ d


def jump(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Jump consistent hash of 64-bit keys; fewer than one bucket counts as one."""
    buckets = max(1, buckets)
    key, b, j = keys.astype(U), np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
    open_ = np.arange(len(keys))
    while len(open_):
        b[open_] = j[open_]
        key[open_] = key[open_] * U(JUMP_MULTIPLIER) + U(1)
        j[open_] = ((b[open_] + 1) * (float(1 << 31) / ((key[open_] >> U(33)).astype(float) + 1))).astype(np.int64)
        open_ = open_[j[open_] < buckets]
    return b


def _over_bytes(kernel: Callable[[list[bytes]], np.ndarray]) -> Callable[[Column], Column]:
    @F.pandas_udf(T.LongType())
    def run(items: pd.Series) -> pd.Series:
        known = items.notna()
        out = pd.Series(pd.NA, index=items.index, dtype="Int64")
        if known.any():
            out[known] = kernel([bytes(x) for x in items[known]]).view(np.int64)
        return out

    def column(item: Column | str) -> Column:
        """BIGINT bit pattern of the hash of a string's UTF-8 or of binary; null for null."""
        return run((F.col(item) if isinstance(item, str) else item).cast("binary"))

    return column


fnv1_64_hash = _over_bytes(fnv1_64)
fnv1_32_hash = _over_bytes(fnv1_32)
crc64_hash = _over_bytes(crc64)
siphash_hash = _over_bytes(siphash24)


def jump_bucket(key: Column | str, buckets: int) -> Column:
    """Bucket of a BIGINT key (bit pattern)."""

    @F.pandas_udf(T.IntegerType())
    def run(keys: pd.Series) -> pd.Series:
        known = keys.notna()
        out = pd.Series(pd.NA, index=keys.index, dtype="Int32")
        out[known] = jump(keys[known].to_numpy(np.int64).view(U), buckets)
        return out

    return run((F.col(key) if isinstance(key, str) else key).cast("bigint"))


def jump_bucket_string(key: Column | str, buckets: int) -> Column:
    return jump_bucket(crc64_hash(key), buckets)


class JumpHasher:
    """Jump hash with a fixed number of buckets, which must be positive."""

    def __init__(self, buckets: int):
        if buckets < 1:
            raise ValueError("buckets must be positive")
        self.buckets = buckets

    def __call__(self, key: Column | str) -> Column:
        return jump_bucket(key, self.buckets)


def unsigned(bits: Column) -> Column:
    """The value of a 64-bit pattern as DECIMAL(20,0)."""
    wide = bits.cast("decimal(20,0)")
    return F.when(bits < 0, wide + F.lit(str(TWO64)).cast("decimal(20,0)")).otherwise(wide).cast("decimal(20,0)")
