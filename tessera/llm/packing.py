"""Lexical retrieval packing: documents that share rare terms go into the same training sequence.

Document frequencies and the mean length are those of the whole table. Up to
512 documents (of least hash) are leaders; a document's key names its nearest
leader among the first 8, 32, 128 and 512 and then its most telling term.
Documents are numbered in order of these keys and every SHARD_DOCS of them make
a shard, so that documents that share terms meet in one shard however many
shards there are. Each shard is one BM25 inverted index over token ids. The next
unused document (or the rest of one that was cut) seeds a window; the index
returns the unused documents nearest to it, which fill the window in that order
until it is full. The document in which the window ends is cut there, and its
rest seeds the next window. So every window is full and nothing is padded; what
is left at a shard's end is cut into sequences of falling powers of two, which
need no padding either. Consecutive shards make at most MOST_GROUPS groups; a
task reads a group as a stream and holds one shard. A shard ends early
at SHARD_TOKENS ids, so memory stays bounded. What is broadcast: a
number for each token id, the leaders' terms and two numbers a group. The same
table, read in the same order, always gives the same sequences.

Null and blank texts are documents of the end id alone. Ids may be null or
repeat (repeated rows are packed each). Other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, table
from tessera.llm.tokens import forget, tokenizer
from tessera.operators.ordering import numbered
from tessera.operators.storage import new_path, remove, written

WINDOW, END = 2048, 1
SHARD_DOCS, SHARD_TOKENS = 2000, 1 << 23
#: Runs of shards that are told apart when documents are dealt; bytes of ids of a task.
MOST_GROUPS, TASK_BYTES = 1 << 16, 8 << 20
#: Leaders among which the nearest one is named, level by level.
LEVELS = (8, 32, 128, 512)
#: A term in more than one of so many documents of a shard, or leaders, has a dense row.
DENSE = 8
#: Neighbours that are put in order first.
FIRST = 32
#: Bytes of text that are cut into words at once, and rows of a batch of ids.
TOKENIZED_BYTES, ROWS_AT_ONCE = 16 << 20, 2048
#: BM25's constants.
K1, B = 1.2, 0.75
PIECES = "doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def counted(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ids of a document, in order, and how often each occurs: ``np.unique`` takes longer on so few."""
    if not len(doc):
        return doc, np.zeros(0, np.int64)
    ids = np.sort(doc)
    last = np.append(np.flatnonzero(ids[1:] != ids[:-1]), len(ids) - 1)
    count = last + 1
    count[1:] -= count[:-1].copy()
    return ids[last], count


@dataclass(frozen=True)
class Statistics:
    """Of a whole table: documents, their mean length, and in how many of them each id occurs."""

    docs: int
    mean: float
    df: np.ndarray

    @cached_property
    def idf(self) -> np.ndarray:
        return np.log1p((self.docs - self.df + 0.5) / (self.df + 0.5))

    def impacts(self, term: np.ndarray, tf: np.ndarray, size: np.ndarray | float) -> np.ndarray:
        return self.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / self.mean))

    @classmethod
    def of(cls, docs: list[np.ndarray]) -> Statistics:
        terms = np.concatenate([np.unique(d) for d in docs])
        return cls(len(docs), float(np.mean([len(d) for d in docs])), np.bincount(terms))


class Index:
    """BM25 over the token ids of a shard's documents, with the statistics of the whole table (of ``docs`` if none are given).

    Terms that many documents hold have a dense row of impacts, the others a list of postings.
    """

    def __init__(self, docs: list[np.ndarray], statistics: Statistics | None = None):
        n = len(docs)
        unique = [counted(d) for d in docs]
        sizes = np.array([len(d) for d in docs], float)
        owner = np.repeat(np.arange(n), [len(u) for u, _ in unique])
        term, tf = np.concatenate([u for u, _ in unique]), np.concatenate([c for _, c in unique]).astype(float)
        impact = (statistics or Statistics.of(docs)).impacts(term, tf, sizes[owner]).astype(np.float32)
        order = np.argsort(term, kind="stable")
        terms, first, df = np.unique(term[order], return_index=True, return_counts=True)
        place = np.empty(len(term), np.int64)
        place[order] = np.repeat(np.arange(len(terms)), df)
        common = df * DENSE > n
        self.row = np.where(common, np.cumsum(common) - 1, -1)
        dense = common[place]
        self.dense = np.zeros((int(common.sum()), n), np.float32)
        self.dense[self.row[place[dense]], owner[dense]] = impact[dense]
        self.first, self.df = first, np.where(common, 0, df)
        self.doc, self.impact = owner[order], impact[order]
        edges = np.cumsum([0, *(len(u) for u, _ in unique)])
        self.ask = [place[a:b] for a, b in zip(edges, edges[1:])]

    def scores(self, seed: int) -> np.ndarray:
        """Of every document for the seed's terms."""
        ask = self.ask[seed]
        rows = self.row[ask]
        score = self.dense[rows[rows >= 0]].sum(axis=0)
        size = self.df[ask]
        ends = np.cumsum(size)
        at = np.repeat(self.first[ask] - ends + size, size) + np.arange(ends[-1])
        return score + np.bincount(self.doc[at], self.impact[at], len(score))

    def nearest(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """Unused documents by falling score; those that share nothing come last, in order."""
        score = self.scores(seed)
        free = np.flatnonzero(unused & (score > 0))
        own, given = -score[free], 0
        if len(own) > 4 * FIRST:  # a window seldom takes more than the first few
            best = np.flatnonzero(own < np.partition(own, FIRST)[FIRST])
            best = best[np.argsort(own[best], kind="stable")]
            given = len(best)
            yield from free[best]
        yield from free[np.argsort(own, kind="stable")[given:]]
        yield from np.flatnonzero(unused & (score <= 0))


def pack(docs: list[np.ndarray], window: int = WINDOW, statistics: Statistics | None = None) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) over all ids of ``docs``."""
    index = Index(docs, statistics)
    unused = np.ones(len(docs), bool)
    following = 0
    out: list[list[tuple[int, int, int]]] = []
    rest: tuple[int, int] | None = None  # a document that was cut, and where
    while True:
        if rest is None:
            while following < len(docs) and not unused[following]:
                following += 1
            if following == len(docs):
                break
            rest, unused[following] = (following, 0), False
        seed, room, pieces = rest[0], window, []
        near = None
        while True:
            doc, at = rest
            take = min(room, len(docs[doc]) - at)
            pieces.append((doc, at, take))
            room -= take
            rest = (doc, at + take) if at + take < len(docs[doc]) else None
            if not room:
                break
            near = near or index.nearest(seed, unused)
            doc = next(near, None)
            if doc is None:
                break
            unused[doc] = False
            rest = (int(doc), 0)
        out.append(pieces)
    if not out:
        return out
    filled = sum(p[2] for p in out[-1])
    if filled & (filled - 1):  # the last window: powers of two need no padding
        pieces, size = out.pop(), 1 << (filled.bit_length() - 1)
        part: list[tuple[int, int, int]] = []
        for doc, at, length in pieces:
            while length:
                room = size - sum(p[2] for p in part)
                take = min(room, length)
                part.append((doc, at, take))
                at, length = at + take, length - take
                if take == room:
                    out.append(part)
                    filled -= size
                    part, size = [], 1 << max(0, filled.bit_length() - 1)
    return out


class Router:
    """Keys of documents: their nearest leader on each level, then their most telling term.

    Terms that many leaders hold have a dense row of weights, the others a list of postings.
    """

    def __init__(self, leaders: list[np.ndarray], statistics: Statistics):
        self.statistics = statistics
        self.leaders = len(leaders)
        weights = [self._weights(d) for d in leaders]
        owner = np.repeat(np.arange(len(leaders)), [len(t) for t, _ in weights])
        term = np.concatenate([t for t, _ in weights]).astype(np.int64)
        weight = np.concatenate([w / np.linalg.norm(w) for _, w in weights]).astype(np.float32)
        df = np.bincount(term, minlength=len(statistics.df))
        common = df * DENSE > len(leaders)
        self.row = np.where(common, np.cumsum(common) - 1, -1)
        self.table = np.zeros((int(common.sum()), len(leaders)), np.float32)
        dense = common[term]
        self.table[self.row[term[dense]], owner[dense]] = weight[dense]
        order = np.flatnonzero(~dense)[np.argsort(term[~dense], kind="stable")]
        self.leader, self.weight = owner[order], weight[order]
        self.size = np.where(common, 0, df)
        self.first = np.cumsum(self.size) - self.size

    def _weights(self, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        term, tf = counted(doc)
        return term, self.statistics.impacts(term, tf, len(doc))

    def key(self, doc: np.ndarray) -> int:
        term, weight = self._weights(doc)
        row = self.row[term]
        near = weight[row >= 0].astype(np.float32) @ self.table[row[row >= 0]]
        size = self.size[term]
        ends = np.cumsum(size)
        at = np.repeat(self.first[term] - ends + size, size) + np.arange(ends[-1])
        near = near + np.bincount(self.leader[at], self.weight[at] * np.repeat(weight, size), self.leaders)
        out = 0
        for n in LEVELS:
            out = (out << 9) | int(near[:n].argmax())
        return (out << 24) | int(term[weight.argmax()])


def _some(batches: Iterator[pa.RecordBatch], size: int = TOKENIZED_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about so many bytes: what a batch repeats is looked up once."""
    held, now = [], 0
    for batch in batches:
        held.append(batch)
        now += batch.nbytes
        if now >= size:
            yield pa.concat_batches(held)
            held, now = [], 0
    if held:
        yield pa.concat_batches(held)


def _tokens(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """``doc_id, h, n, ids``: ids as bytes of ``_kind`` numbers. At the end a row of ``n`` = -1 with the number of documents that hold each id, as 64-bit numbers."""
    words, kind = tokenizer(path), np.dtype(_kind(path))
    df, id_type = np.zeros(0, np.int64), None
    for batch in _some(batches):
        if not batch.num_rows:
            continue
        id_type = batch.column(0).type
        flat, start = words.of(batch.column(2))
        flat, docs = flat.astype(kind), batch.num_rows
        ends = np.insert(flat, start[1:], END)  # one end after each document
        edges = start + np.arange(docs + 1)
        terms = np.concatenate([counted(ends[a:b])[0] for a, b in zip(edges, edges[1:])])
        found = np.bincount(terms, minlength=len(df))
        found[: len(df)] += df
        df = found
        for i in range(0, docs, ROWS_AT_ONCE):
            own = edges[i : i + ROWS_AT_ONCE + 1]
            data = ends[own[0] : own[-1]]
            ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(own) - 1, [None, pa.py_buffer(((own - own[0]) * kind.itemsize).astype("<i8")), pa.py_buffer(data)])
            rows = batch.slice(i, len(own) - 1)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(np.diff(own)), ids.cast(pa.binary())], names=["doc_id", "h", "n", "ids"])
    if len(df):
        yield pa.RecordBatch.from_arrays([pa.nulls(1, id_type), pa.array([0]), pa.array([-1]), pa.array([df.astype("<i8").tobytes()], pa.binary())], names=["doc_id", "h", "n", "ids"])


def _kind(path: str) -> str:
    return "<u2" if tokenizer(path).tokenizer.get_vocab_size() <= 1 << 16 else "<u4"


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the counts that ``_tokens`` left."""
    df = np.zeros(0, np.int64)
    for batch in batches:
        for data in batch.column(0).to_pylist():
            found = np.frombuffer(data, "<i8").copy()
            short, found = sorted((df, found), key=len)
            found[: len(short)] += short
            df = found
    term = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(df[term])], names=["term", "df"])


def _routed(batches: Iterator[pa.RecordBatch], kind: str, shared) -> Iterator[pa.RecordBatch]:
    forget()
    leaders, statistics = shared.value
    router = None
    for batch in batches:
        if not batch.num_rows:
            continue
        router = router or Router([np.frombuffer(i, kind) for i in leaders], statistics)
        keys = [router.key(np.frombuffer(i, kind)) for i in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], names=["doc_id", "h", "ids", "key"])


def _grouped(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """The group of each row, and its first ``key, o``: the last one that is at most the row's own."""
    first = shared.value
    for batch in batches:
        own = np.rec.fromarrays([batch.column(i).to_numpy() for i in (3, 4)], dtype=first.dtype)
        group = np.maximum(np.searchsorted(first, own, side="right") - 1, 0)
        yield pa.RecordBatch.from_arrays([pa.array(group), *batch.columns[:3], batch.column(3), batch.column(4)], names=["shard", "doc_id", "h", "ids", "key", "o"])


def _pack_partition(batches: Iterator[pa.RecordBatch], token_kind: str, window: int, shared) -> Iterator[pa.RecordBatch]:
    """Batches of ``shard, doc_id, ids`` sorted by group (``shard``) and key: a shard for every ``SHARD_DOCS`` documents of a group."""
    statistics = shared.value[1]
    shard, made, ids, tokens, held = None, 0, [], [], 0
    kind = None

    def flush() -> pa.RecordBatch:
        nonlocal made
        sequences = pack(tokens, window, statistics)
        rows = []
        for n, pieces in enumerate(sequences, made):
            offset = 0
            for doc, at, length in pieces:
                crc = zlib.crc32(tokens[doc][at : at + length].tobytes())
                rows.append((ids[doc], at, length, crc, len(tokens[doc]), (shard << 32) + n, offset))
                offset += length
        made += len(sequences)
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    for batch in batches:
        kind = batch.column(1).type
        for s, d, own in zip(*(c.to_pylist() for c in batch.columns)):
            if ids and (s != shard or len(ids) >= SHARD_DOCS or held >= SHARD_TOKENS):
                yield flush()
                ids, tokens, held = [], [], 0
            if s != shard:
                shard, made = s, 0
            ids.append(d)
            tokens.append(np.frombuffer(own, token_kind).astype("<u4"))
            held += len(tokens[-1])
    if ids:
        yield flush()


def packed(docs: DataFrame, tokenizer_path: str, window: int = WINDOW) -> DataFrame:
    """A row per piece: where its ids lie in their document and in which sequence."""
    kind, context = docs.schema["doc_id"].dataType.simpleString(), docs.sparkSession.sparkContext
    ids_kind = _kind(tokenizer_path)
    path = new_path(docs.sparkSession, "tokens")
    map_arrow(docs.select("doc_id", F.xxhash64("text").alias("h"), "text"), lambda b: _tokens(b, tokenizer_path), f"doc_id {kind}, h bigint, n bigint, ids binary").write.parquet(path)
    every = docs.sparkSession.read.parquet(path)
    tokens = every.filter("n >= 0")
    count, total = tokens.agg(F.count(F.lit(1)), F.sum("n")).first()
    df = np.zeros(1 << (8 * np.dtype(ids_kind).itemsize if ids_kind == "<u2" else 20), np.int64)
    counted = map_arrow(every.filter("n < 0").select("ids"), _term_counts, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df[counted.column(0).to_numpy()] = counted.column(1).to_numpy()
    # leaders: different texts of least hash; only hashes are ordered, then the few texts are fetched
    chosen = [r.h for r in tokens.select("h").distinct().orderBy(F.xxhash64("h"), "h").limit(LEVELS[-1]).collect()]
    texts = {r.h: bytes(r.ids) for r in tokens.filter(F.col("h").isin(chosen)).groupBy("h").agg(F.min("ids").alias("ids")).collect()} if chosen else {}
    shared = context.broadcast(([texts[h] for h in chosen], Statistics(count, (total or 0) / max(1, count), df)))
    routed = written(map_arrow(tokens.select("doc_id", "h", "ids"), lambda b: _routed(b, ids_kind, shared), f"doc_id {kind}, h bigint, ids binary, key bigint").withColumn("o", F.xxhash64("doc_id", "h", F.monotonically_increasing_id())))
    remove(docs.sparkSession, path)  # the routed table holds the ids now
    # a group is a whole number of shards, so where groups end changes no shard
    each = SHARD_DOCS * max(1, -(-count // (SHARD_DOCS * MOST_GROUPS)))
    order = routed.select("key", "o", F.monotonically_increasing_id().alias("row"))
    first = numbered(order, ["key", "o", "row"]).filter(F.col("n") % each == 0).select("key", "o").distinct().orderBy("key", "o").toArrow()
    starts = np.rec.fromarrays([c.to_numpy() for c in first.columns], dtype=[("key", "<i8"), ("o", "<i8")])
    firsts = context.broadcast(starts)
    dealt = map_arrow(routed, lambda b: _grouped(b, firsts), f"shard bigint, doc_id {kind}, h bigint, ids binary, key bigint, o bigint")
    size = (total or 0) * np.dtype(ids_kind).itemsize
    parts = max(1, min(len(starts), int(-(-size // TASK_BYTES)), MOST_GROUPS))
    placed = dealt.repartition(parts, "shard").sortWithinPartitions("shard", "key", "o").select("shard", "doc_id", "ids")
    return map_arrow(placed, lambda b: _pack_partition(b, ids_kind, window, shared), PIECES.format(kind=kind))


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op6_retrieval_packing(spark, sf_dir) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), default_tokenizer())
