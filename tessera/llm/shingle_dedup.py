"""Near-duplicate texts by SimHash of their word shingles, verified by the Jaccard similarity of the sets.

A text is lower-cased in A-Z and cut into words at ASCII white space; its set
holds every run of ``width`` words (the whole text if it is shorter), as 64-bit
hashes. Texts link when their sets' similarity is at least ``similarity``;
chains of links make a component. Texts without words have the empty set and
are copies of each other.

Candidates come from SimHash as in ``simhash_dedup``: the different shingles of
a set vote, fingerprints are linked at RADIUS or fewer differing bits by the
Gray-ordered tables, and the sets of one component meet. At a similarity of 0.8
fingerprints differ in about 10 bits, which no such table reaches; so sets also
meet by MinHash: BANDS keys of ROWS minima each, so that a pair of
similarity s meets under some key with probability 1 - (1 - s^ROWS)^BANDS
(0.99997 at 0.8). Every link is then verified on the whole sets. Equal sets are
folded before, so a group of copies of any size costs one row. In one group
rows are compared only while they are in different components, so a large group
of near copies costs about one comparison a row, and no step emits its pairs.
Sets of one group lie in one task: 8 bytes a shingle.

Ids may be null or repeat. Other columns are carried along; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow
from tessera.llm.components import components
from tessera.llm.gray_index import hamming_links
from tessera.llm.line_dedup import FILTER_WORDS, SENT, _filter_bits, _groups
from tessera.llm.simhash_dedup import SEED, majority, survivors
from tessera.operators.storage import written

WIDTH, SIMILARITY = 5, 0.8
RADIUS = 3
BANDS, ROWS = 20, 4
#: Shingles whose minima are sought at once.
AT_ONCE = 1 << 12

_RNG = np.random.default_rng(SEED)
_FACTORS = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted set of hashes of a text's word runs."""
    words = (text or "").encode().lower().split()  # on bytes: A-Z only, ASCII white space
    digest, n = xxhash.xxh64_intdigest, len(words)
    h = np.fromiter((digest(w, SEED) for w in words), np.uint64, n)
    k = min(width, n)
    out = np.zeros(n - k + 1 if n else 0, np.uint64)
    for i in range(k):
        out = out * _STEP + h[i : n - k + 1 + i]
    return np.unique(_mixed(out))


def band_keys(found: np.ndarray) -> np.ndarray:
    """BANDS signed keys of a set that is not empty."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), AT_ONCE):
        least = np.minimum(least, (_FACTORS[:, None] * found[None, i : i + AT_ONCE]).min(axis=1))
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        out = _mixed(out * _STEP + column)
    return out.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """``doc_id, h, fp, sim, keys``: fp tells the sets apart, sim is their SimHash."""
    for batch in batches:
        fp, sim, keys = [], [], []
        for text in batch.column(2).to_pylist():
            found = shingles(text, width)
            fp.append(xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63))
            sim.append(majority(found))
            keys.append(band_keys(found) if len(found) else np.zeros(0, np.int64))
        ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp, pa.int64()), pa.array(sim, pa.int64()), listed], names=["doc_id", "h", "fp", "sim", "keys"])


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key: those whose key has several sets, under a name of the group. Keys of the same members give the same rows."""
    for rows in _groups(batches, ["key", "fp"]):
        key, fp = rows["key"], rows["fp"]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(start, len(key)))
        name = np.bitwise_xor.reduceat(_mixed(fp.view(np.uint64) * _STEP), start) * _STEP + np.add.reduceat(_mixed(fp.view(np.uint64)), start)
        keep = np.repeat(size > 1, size)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(name.view(np.int64), size)[keep]), pa.array(fp[keep])], names=["at", "fp"])


def _sets(batches: Iterator[pa.RecordBatch], width: int, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``h, set`` of the texts whose bit is set."""
    sent: set[int] = set()  # texts that this task has sent; forgetting some only costs repeated rows
    for batch in batches:
        h = batch.column(0).to_numpy()
        maybe = bits[(h >> 6) & (FILTER_WORDS - 1)].view(np.uint64) >> (h & 63).astype(np.uint64) & np.uint64(1)
        out, data = [], []
        for i in np.flatnonzero(maybe):
            own = int(h[i])
            if own not in sent:
                sent.add(own)
                out.append(own)
                data.append(shingles(batch.column(1)[int(i)].as_py(), width).astype("<u8").tobytes())
        if len(sent) > SENT:
            sent.clear()
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), pa.array(data, pa.binary())], names=["h", "set"])


def link_sets(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set the index of the first one of its component, by links of at least ``similarity``."""
    n = len(sets)
    label, open_ = np.arange(n), np.ones(n, bool)
    size = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.int64)
    while True:
        # a row of the smallest component: the others need no comparison within a large one
        left = np.flatnonzero(open_)
        counts = np.bincount(label, minlength=n)
        if not len(left) or (label[left] == label[left[0]]).all():
            return label
        p = left[np.argmin(counts[label[left]])]
        open_[p] = False
        others = np.flatnonzero(open_ & (label != label[p]) & (np.minimum(size, size[p]) >= similarity * np.maximum(size, size[p]) - 1e-9))
        if not len(others):
            continue
        own = ids[starts[p] : starts[p + 1]]
        mark[own] = 1
        if len(others) * 8 < n:
            shared = np.array([mark[ids[starts[o] : starts[o + 1]]].sum() for o in others])
        else:
            shared = np.add.reduceat(mark[ids], starts[:-1])[others]
        mark[own] = 0
        near = others[shared >= similarity * (size[others] + size[p] - shared) - 1e-9]
        joined = np.unique(label[np.append(near, p)])
        label[np.isin(label, joined)] = joined[0]


def _verify(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """From rows ``at, fp, set`` sorted by group: links between each set and the first of its component there."""
    now, fps, sets = None, [], []

    def links() -> pa.RecordBatch:
        label = link_sets(sets, similarity) if len(sets) > 1 else np.arange(len(sets))
        moved = np.flatnonzero(label != np.arange(len(sets)))
        fp = np.array(fps, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[label[moved]])], names=["a", "b"])

    for batch in batches:
        for at, fp, data in zip(*(c.to_pylist() for c in batch.columns)):
            if at != now:
                if sets:
                    yield links()
                now, fps, sets = at, [], []
            fps.append(fp)
            sets.append(np.frombuffer(data, "<u8"))
    if sets:
        yield links()


def simhash_keys(each: DataFrame, radius: int) -> DataFrame:
    """``key, fp`` of every set of ``each``: the least SimHash of the component that fingerprints within the radius make."""
    sets = each.select("fp", "sim").distinct()
    roots = components(hamming_links(sets.select("sim").distinct(), radius, "sim")).select(F.col("node").alias("sim"), "root")
    return sets.join(roots, "sim", "left").select(F.coalesce("root", "sim").alias("key"), "fp")


def similar_links(docs: DataFrame, each: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links ``a, b`` between the sets of ``each`` whose closure joins what links of at least ``similarity`` join, among sets that share a SimHash component or a MinHash key."""
    distinct = each.groupBy("fp").agg(F.min("keys").alias("keys"))
    keys = simhash_keys(each, RADIUS).union(distinct.select(F.explode("keys"), "fp"))
    keyed = keys.repartition("key").sortWithinPartitions("key")
    meeting = written(map_arrow(keyed, _meeting, "at bigint, fp bigint").distinct())
    wanted = written(each.join(meeting.select("fp").distinct(), "fp", "left_semi").groupBy("fp").agg(F.min("h").alias("h")))
    bits = docs.sparkSession.sparkContext.broadcast(_filter_bits(wanted))  # of fixed size
    texts = map_arrow(docs.select(F.xxhash64("text").alias("h"), "text"), lambda b: _sets(b, width, bits.value), "h bigint, set binary")
    sets = texts.join(wanted, "h").groupBy("fp").agg(F.min("set").alias("set"))
    placed = meeting.join(sets, "fp").select("at", "fp", "set").repartition("at").sortWithinPartitions("at", "fp")
    return map_arrow(placed, lambda b: _verify(b, similarity), "a bigint, b bigint")


def keep_one_similar(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each component: the one of least id (nulls last), then of least text hash."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    known = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    each = written(map_arrow(known, lambda b: _signed(b, width), f"doc_id {kind}, h bigint, fp bigint, sim bigint, keys array<bigint>"))
    return survivors(docs, each, similar_links(docs, each, width, similarity))
