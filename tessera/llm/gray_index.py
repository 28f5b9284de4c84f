"""Hamming links by Gray-ordered hierarchical indexes.

Fingerprints are put into permuted tables. A table moves some bit blocks to the
front, so that two fingerprints within the radius agree on the whole front in
at least one table (pigeonhole). Rows of a table are sorted by Gray rank: rows
that share leading bits stay together, and neighbours differ in few bits. The
front is the index's first level of masked patterns. Below it, each group of
equal fronts gets a binary tree over Gray order whose nodes hold the bits that
all rows below them share; two subtrees are compared by the differences of
their shared bits and dropped as soon as those exceed the radius.

A group is joined inside one task and gives at most one link per row (to the
smallest row of its connected part), never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a leaf, and leaf pairs that are compared at once.
LEAF, AT_ONCE = 32, 2048


def blocks(radius: int, spare: int = 2) -> list[tuple[int, int]]:
    """(lowest bit, width) of ``radius + spare`` blocks that cover 64 bits."""
    n = radius + spare
    edges = [64 * i // n for i in range(n + 1)]
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:])]


def tables(radius: int, spare: int = 2) -> list[tuple[list[tuple[int, int]], int]]:
    """For each table its blocks, leading ones first, and the number of leading bits."""
    cuts = blocks(radius, spare)
    out = []
    for front in combinations(range(len(cuts)), spare):
        order = [cuts[i] for i in front] + [c for i, c in enumerate(cuts) if i not in front]
        out.append((order, sum(cuts[i][1] for i in front)))
    return out


def permuted(fp: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    out, left = np.zeros_like(fp), 64
    for low, width in order:
        left -= width
        out |= ((fp >> np.uint64(low)) & np.uint64((1 << width) - 1)) << np.uint64(left)
    return out


def gray_rank(code: np.ndarray) -> np.ndarray:
    """Place of 64-bit codes in the reflected Gray sequence."""
    for s in (1, 2, 4, 8, 16, 32):
        code = code ^ (code >> np.uint64(s))
    return code


def _spread(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for t, (order, front) in enumerate(tables(radius)):
            rank = gray_rank(permuted(fp, order))
            key = (rank >> np.uint64(64 - front)).view(np.int64)
            # flipped sign bit: Spark sorts signed
            signed = (rank ^ np.uint64(1 << 63)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), t, np.int32)), pa.array(key), pa.array(signed), batch.column(0)], names=["t", "key", "rank", "fp"])


def _join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unites the sets of a[i] and b[i]; label holds each row's smallest known row and stays idempotent."""
    while True:
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            return
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label[label] != label).any():
            label[:] = label[label]


def link_group(codes: np.ndarray, radius: int) -> np.ndarray:
    """For codes (uint64, in Gray order) the index of the first row of each one's connected part."""
    n = len(codes)
    label = np.arange(n)
    size = 1 << max(0, int(np.ceil(np.log2(max(1, -(-n // LEAF))))))
    padded = np.concatenate([codes, np.repeat(codes[-1:], size * LEAF - n)]).reshape(size, LEAF)
    value, differ = [padded[:, 0]], [np.bitwise_or.reduce(padded ^ padded[:, :1], axis=1)]
    while len(value[-1]) > 1:  # upper nodes: the shared bits of two lower ones
        v, d = value[-1], differ[-1]
        value.append(v[::2])
        differ.append(d[::2] | d[1::2] | (v[::2] ^ v[1::2]))
    frontier = [(len(value) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    row = np.arange(size * LEAF).reshape(size, LEAF)
    while frontier:
        level, a, b = frontier.pop()
        if len(a) > AT_ONCE:
            frontier += [(level, a[i : i + AT_ONCE], b[i : i + AT_ONCE]) for i in range(0, len(a), AT_ONCE)]
            continue
        v, d = value[level], differ[level]
        near = np.bitwise_count((v[a] ^ v[b]) & ~(d[a] | d[b])) <= radius
        a, b = a[near], b[near]
        if level:
            left = np.concatenate([2 * a, 2 * a, 2 * a + 1, 2 * a + 1])
            right = np.concatenate([2 * b, 2 * b + 1, 2 * b, 2 * b + 1])
            keep = left <= right
            frontier.append((level - 1, left[keep], right[keep]))
            continue
        at = np.minimum(row, n - 1)
        own = label[at]
        one = (own == own[:, :1]).all(axis=1)  # a leaf whose rows are one part already
        todo = ~(one[a] & one[b] & (own[a, 0] == own[b, 0]))
        a, b = a[todo], b[todo]
        if len(a):
            hit = np.bitwise_count(padded[a][:, :, None] ^ padded[b][:, None, :]) <= radius
            p, i, j = np.nonzero(hit)
            _join_labels(label, at[a[p], i], at[b[p], j])
    return label


def _link_partition(batches: Iterator[pa.RecordBatch], radius: int, front: list[int]) -> Iterator[pa.RecordBatch]:
    """Batches of ``t, rank, fp`` sorted by table and rank. Holds one group and one batch at a time."""
    shift = np.array([64 - bits for bits in front], dtype=np.uint64)
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def links(t: np.ndarray, rank: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        key = rank >> shift[t]
        start = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (key[1:] != key[:-1])]))
        end = np.concatenate([start[1:], [len(t)]])
        a, b = [], []
        codes = rank ^ (rank >> np.uint64(1))
        two = end - start == 2
        s = start[two]
        s = s[np.bitwise_count(codes[s] ^ codes[s + 1]) <= radius]
        a.append(fp[s])
        b.append(fp[s + 1])
        for s, e in zip(start[end - start > 2], end[end - start > 2]):
            label = link_group(codes[s:e], radius)
            moved = np.flatnonzero(label != np.arange(e - s))
            a.append(fp[s + moved])
            b.append(fp[s + label[moved]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        t, rank, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        rank = rank.view(np.uint64) ^ np.uint64(1 << 63)
        kept.append((t, rank, fp))
        last = (rank[-1] >> shift[t[-1]], t[-1])
        first = (kept[0][1][0] >> shift[kept[0][0][0]], kept[0][0][0])
        if first == last:  # one group so far
            continue
        t, rank, fp = (np.concatenate(x) for x in zip(*kept))
        tail = np.flatnonzero((t != last[1]) | (rank >> shift[t] != last[0]))[-1] + 1
        kept = [(t[tail:], rank[tail:], fp[tail:])]
        yield links(t[:tail], rank[:tail], fp[:tail])
    if kept:
        yield links(*(np.concatenate(x) for x in zip(*kept)))


def hamming_links(fps: DataFrame, radius: int = 3, fp: str = "fp") -> DataFrame:
    """Links ``a, b`` between different 64-bit fingerprints whose transitive closure joins exactly those that chains of at most ``radius`` differing bits join.

    ``fps`` holds each fingerprint once; nulls are ignored.
    """
    plan = tables(radius)
    front = [bits for _, bits in plan]
    spread = fps.filter(F.col(fp).isNotNull()).select(fp).mapInArrow(lambda batches: _spread(batches, radius), "t int, key bigint, rank bigint, fp bigint")
    placed = spread.repartition("t", "key").sortWithinPartitions("t", "rank").select("t", "rank", "fp")
    return placed.mapInArrow(lambda batches: _link_partition(batches, radius, front), "a long, b long")
