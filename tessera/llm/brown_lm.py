"""A class-based bigram language model with classes by exchange clustering.

P(text) is the product over its tokens (words, then one end) of
P(class | class before) * P(word | class). The end is a class of its own and
also stands before the first word.

Classes come in three steps, each with counts of all training documents.
1. The at most CORE most frequent words are units of their own, any other word
   falls into one of RARE units by its ending. The exchange algorithm moves
   units between CLASSES classes as long as the class bigram likelihood grows,
   until a sweep moves nothing; the driver holds a unit-by-unit table of bounded
   size.
2. Every other word of the at most CLASSED most frequent ones moves, by the same
   likelihood, to the class that suits the classes before and behind its own
   occurrences best: a distributed pass, a word at a time, that grows with the
   vocabulary.
3. Class bigrams are counted again with these classes. Words beyond CLASSED and
   words that were never seen keep the class of their ending.
Transitions are smoothed towards the class shares, emissions by adding DELTA,
with one place for unknown words in each class.

Words are counted over all training documents as (hash, ending, count) rows.
Classes and counts of the at most CLASSED most frequent words are broadcast
(17 bytes a word) and their tokens are scored where the document is; the tokens
of all other words meet their counts in a shuffle join on the hash. Nothing is
dropped or sampled.

Null texts have no words but an end. Ids may be null (such documents are
trained on) or repeat; equal rows stay apart. Other columns are ignored; an
empty table gives an empty result; without training documents every
probability is that of an unknown word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, table
from tessera.llm.langid import part
from tessera.operators.storage import written

CORE, RARE, CLASSES, CLASSED = 1000, 512, 64, 1 << 20
#: Occurrences from which a word's own contexts choose its class.
OWN, DELTA, PULL = 2, 0.1, 5.0
#: Different words that a task remembers.
CACHE = 300_000


class Words:
    """Numbers for words, with their hashes and endings, kept for a bounded number of words."""

    def __init__(self):
        self.code: dict[bytes, int] = {}
        self.h = np.zeros(0, np.int64)
        self.ending = np.zeros(0, np.int32)

    def ids(self, lists: list[list[bytes]]) -> np.ndarray:
        code, before = self.code, len(self.code)
        number = code.setdefault
        out = np.fromiter((number(w, len(code)) for w in chain.from_iterable(lists)), np.int64, sum(map(len, lists)))
        new = list(islice(code, before, None))
        if new:
            digest, crc = xxhash.xxh3_64_intdigest, zlib.crc32
            self.h = np.concatenate([self.h, np.fromiter(map(digest, new), np.uint64, len(new)).view(np.int64)])
            self.ending = np.concatenate([self.ending, np.fromiter((crc(w[-3:]) % RARE for w in new), np.int32, len(new))])
        return out

    @property
    def full(self) -> bool:
        return len(self.code) > CACHE


class Kept:
    """What a function of hashes and endings gives for words, computed once a word."""

    def __init__(self, function):
        self.function, self.words, self.value = function, None, np.zeros(0)

    def __call__(self, words: Words) -> np.ndarray:
        if self.words is not words:
            self.words, self.value = words, self.function(words.h, words.ending)
        n = len(self.value)
        if n < len(words.h):
            self.value = np.concatenate([self.value, self.function(words.h[n:], words.ending[n:])])
        return self.value


def _words(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []  # on bytes: A-Z only, ASCII white space


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``h, ending, n`` of words; the end of a text has a null hash."""
    words, total, ends = Words(), np.zeros(0, np.int64), 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(words.h), pa.array(words.ending), pa.array(total)], names=["h", "ending", "n"])

    for batch in batches:
        ends += batch.num_rows
        ids = words.ids([_words(t) for t in batch.column(0).to_pylist()])
        total = np.concatenate([total, np.zeros(len(words.code) - len(total), np.int64)])
        total += np.bincount(ids, minlength=len(total))
        if words.full:
            yield flush()
            words, total = Words(), np.zeros(0, np.int64)
    yield flush()
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([0], pa.int32()), pa.array([ends])], names=["h", "ending", "n"])


def _place(sorted_: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each hash lies in the sorted ones, and whether it is there."""
    if not len(sorted_):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(sorted_, h), len(sorted_) - 1)
    return at, sorted_[at] == h


@dataclass
class Units:
    """Units of words: the core words by hash, then the endings, then the end of a text."""

    core: np.ndarray  # sorted hashes

    @property
    def end(self) -> int:
        return len(self.core) + RARE

    def of(self, h: np.ndarray, ending: np.ndarray) -> np.ndarray:
        at, known = _place(self.core, h)
        return np.where(known, at, len(self.core) + ending)


def _stream(lists: list[list[bytes]], values: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """``values`` of the words with an ``end`` after each text, and where each text starts in it."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    out = np.full(len(values) + len(lists), end, np.int64)
    start = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    out[np.arange(len(values)) + np.repeat(np.arange(len(lists)), sizes)] = values
    return out, start


def _bigrams(batches: Iterator[pa.RecordBatch], number, n: int, end: int) -> Iterator[pa.RecordBatch]:
    """Counts of pairs of what ``number`` makes of words, with ``end`` around each text."""
    words, number = Words(), Kept(number)
    table_ = np.zeros(n * n, np.int64)
    for batch in batches:
        if words.full:
            words = Words()
        lists = [_words(t) for t in batch.column(0).to_pylist()]
        ids = words.ids(lists)
        stream, _ = _stream(lists, number(words)[ids], end)
        before = np.concatenate([[end], stream[:-1]])
        codes, seen = np.unique(before * n + stream, return_counts=True)
        table_[codes] += seen
    yield from _rows(table_.reshape(n, n), range(n))


def _contexts(batches: Iterator[pa.RecordBatch], units: Units, label: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``h, data`` of the words in ``own`` (sorted hashes): the classes before and behind each occurrence, as 16-bit codes, or how often each comes where that is shorter."""
    words, ids, codes, k = Words(), [], [], int(label.max()) + 1
    end = label[units.end]
    first, mine_ = Kept(lambda h, e: label[units.of(h, e)]), Kept(lambda h, e: _place(own, h)[1])

    def flush() -> Iterator[pa.RecordBatch]:
        word, code = np.concatenate([*ids, np.zeros(0, np.int64)]), np.concatenate([*codes, np.zeros(0, np.uint16)])
        order = np.argsort(word, kind="stable")
        word, code = word[order], code[order]
        start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
        data = []
        for a, z in zip(start.tolist(), np.append(start[1:], len(word)).tolist()):
            some = code[a:z]
            if z - a > 4 * k:
                some = np.concatenate([np.bincount(some // k, minlength=k), np.bincount(some % k, minlength=k)]).astype("<i8")
            data.append(some.tobytes())
        for i in range(0, len(start), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(words.h[word[start[i : i + 20_000]]]), pa.array(data[i : i + 20_000], pa.binary())], names=["h", "data"])

    for batch in batches:
        lists = [_words(t) for t in batch.column(0).to_pylist()]
        number = words.ids(lists)
        cls = first(words)
        stream, _ = _stream(lists, number, -1)
        c = np.where(stream >= 0, cls[stream] if len(cls) else end, end)
        code = np.concatenate([[end], c[:-1]]) * k + np.append(c[1:], end)
        mine = np.flatnonzero(stream >= 0)
        mine = mine[mine_(words)[stream[mine]]]
        ids.append(stream[mine])
        codes.append(code[mine].astype(np.uint16))
        if words.full:
            yield from flush()
            words, ids, codes = Words(), [], []
    yield from flush()


def _choose(batches: Iterator[pa.RecordBatch], before: np.ndarray, behind: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``h, class`` from rows of ``_contexts`` sorted by h: the class of greatest likelihood, ties to the lowest."""
    k = len(size)
    held: tuple[int, np.ndarray] | None = None

    def chosen(h: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        seen = counts[:, :k].sum(axis=1)
        gain = counts[:, :k] @ before + counts[:, k:] @ behind - seen[:, None] * size
        gain[:, 0] = -np.inf  # the class of the end
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(gain.argmax(axis=1).astype(np.int32))], names=["h", "class"])

    for batch in batches:
        if not batch.num_rows:
            continue
        h = batch.column(0).to_numpy()
        data = batch.column(1).to_pylist()
        words, which = np.unique(h, return_inverse=True)
        counts = np.zeros((len(words), 2 * k))
        raw = [i for i, d in enumerate(data) if len(d) != 16 * k]
        code = np.frombuffer(b"".join(data[i] for i in raw), "<u2").astype(np.int64)
        owner = np.repeat(which[raw], [len(data[i]) // 2 for i in raw]) if raw else np.zeros(0, np.int64)
        flat = counts.ravel()
        flat += np.bincount(owner * 2 * k + code // k, minlength=flat.size) + np.bincount(owner * 2 * k + k + code % k, minlength=flat.size)
        for i, d in enumerate(data):
            if len(d) == 16 * k:
                counts[which[i]] += np.frombuffer(d, "<i8")
        if held is not None:
            if held[0] == words[0]:
                counts[0] += held[1]
            else:
                yield chosen(np.array([held[0]]), held[1][None])
        held = (int(words[-1]), counts[-1])
        yield chosen(words[:-1], counts[:-1])
    if held is not None:
        yield chosen(np.array([held[0]]), held[1][None])


def _rows(rows: np.ndarray, numbers) -> Iterator[pa.RecordBatch]:
    packed = [zlib.compress(r.astype("<i8").tobytes(), 1) for r in rows]
    yield pa.RecordBatch.from_arrays([pa.array(list(numbers), pa.int32()), pa.array(packed, pa.binary())], names=["unit", "data"])


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), "<i8")


def _add_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for unit, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            row = _unpacked(data)
            total[unit] = total[unit] + row if unit in total else row
    if total:
        yield from _rows(np.array(list(total.values())), total)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(counts: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """Classes of units from their bigram counts; the last unit is the end, alone in class 0.

    Units start in classes by rank; each in turn, frequent ones first, goes to
    the class that gives the greatest class bigram likelihood, ties to the
    lowest. Stops when a sweep moves nothing, however many that takes, or when
    moves are so small that the likelihood in doubles does not grow any more.
    """
    n = len(counts) - 1
    classes = max(2, min(classes, n + 1))
    order = np.argsort(-counts.sum(0)[:n], kind="stable")
    label = np.zeros(n + 1, np.int64)
    label[order] = 1 + np.arange(n) % (classes - 1)
    member = np.zeros((n + 1, classes))
    member[np.arange(n + 1), label] = 1
    to, fro = counts @ member, (member.T @ counts).T  # unit to class, class to unit
    joint = member.T @ to
    row, col = joint.sum(1), joint.sum(0)
    best, moved = -np.inf, 1
    while moved:
        likelihood = _xlogx(joint).sum() - _xlogx(row).sum() - _xlogx(col).sum()
        if likelihood <= best:
            break
        best, moved = likelihood, 0
        for w in order:
            out_total, in_total, self_ = to[w].sum(), fro[w].sum(), counts[w, w]
            if not out_total and not in_total:
                continue
            old = label[w]
            r, s = to[w].copy(), fro[w].copy()
            r[old] -= self_
            s[old] -= self_
            joint[old] -= r
            joint[:, old] -= s
            joint[old, old] -= self_
            row[old] -= out_total
            col[old] -= in_total
            gain = (_xlogx(joint + r) - _xlogx(joint)).sum(1) + (_xlogx(joint + s[:, None]) - _xlogx(joint)).sum(0)
            d = np.diag(joint)
            gain += _xlogx(d + r + s + self_) - _xlogx(d + r) - _xlogx(d + s) + _xlogx(d)
            gain -= _xlogx(row + out_total) - _xlogx(row) + _xlogx(col + in_total) - _xlogx(col)
            gain[0] = -np.inf
            new = old if gain[old] >= gain.max() - 1e-9 else int(gain.argmax())
            joint[new] += r
            joint[:, new] += s
            joint[new, new] += self_
            row[new] += out_total
            col[new] += in_total
            if new != old:
                moved += 1
                label[w] = new
                to[:, old] -= counts[:, w]
                to[:, new] += counts[:, w]
                fro[:, old] -= counts[w]
                fro[:, new] += counts[w]
    return label


def _classes(h: np.ndarray, ending: np.ndarray, units: Units, label: np.ndarray, head: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Of head words their own, of others that of their unit."""
    at, known = _place(head, h)
    out = own[at] if len(head) else np.zeros(len(h), np.int64)
    out[~known] = label[units.of(h[~known], ending[~known])]
    return out


@dataclass
class Model:
    units: Units
    label: np.ndarray  # class by unit
    own: np.ndarray  # class of each head word
    transition: np.ndarray  # log10, by class before and class
    emission: np.ndarray  # log10 of a class's denominator
    head: np.ndarray  # sorted hashes of the head words
    count: np.ndarray  # their counts
    n: int
    v: int
    ends: int

    def classes(self, h: np.ndarray, ending: np.ndarray) -> np.ndarray:
        return _classes(h, ending, self.units, self.label, self.head, self.own)

    def of(self, h: np.ndarray, ending: np.ndarray) -> np.ndarray:
        """A row for each word: its class, whether it is known, and the logs of its emission and its base probability (0 if not)."""
        at, known = _place(self.head, h)
        cls = self.classes(h, ending)
        c = self.count[at] if len(self.head) else np.zeros(len(h))
        return np.stack([cls, known, np.where(known, np.log10(c + DELTA) - self.emission[cls], 0.0), np.where(known, self.base(c), 0.0)], axis=1)

    def base(self, c):
        return np.log10((c + DELTA) / (self.n + DELTA * (self.v + 1)))


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    row = (context.partitionId() if context else 0) << 33
    words = Words()
    of = Kept(model.of)
    end_class = model.label[model.units.end]
    for batch in batches:
        if words.full:
            words = Words()
        lists = [_words(t) for t in batch.column(2).to_pylist()]
        ids = words.ids(lists)
        cls, known, emit, base = of(words).T
        cls, known = cls.astype(np.int64), known.astype(bool)
        stream, start = _stream(lists, ids, -1)
        word = stream >= 0
        k = np.where(word, cls[stream], end_class) if len(cls) else np.full(len(stream), end_class)
        before = np.concatenate([[end_class], k[:-1]])
        score, plain, hit = model.transition[before, k], np.full(len(stream), model.base(model.ends)), np.full(len(stream), int(model.ends > 0))
        score[word] += emit[stream[word]]
        plain[word] = base[stream[word]]
        hit[word] = known[stream[word]]
        tail = np.flatnonzero(word)
        tail = tail[~known[stream[tail]]]
        edges = np.searchsorted(tail, np.append(start, len(stream))).astype(np.int32)
        lists_of = [pa.ListArray.from_arrays(pa.array(edges), pa.array(x)) for x in (words.h[stream[tail]], k[tail].astype(np.int32))]
        sums = [np.add.reduceat(x, start) for x in (hit.astype(np.int64), plain, score)]
        number = row + np.arange(len(lists))
        row += len(lists)
        sizes = np.diff(np.append(start, len(stream)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(number), batch.column(0), batch.column(1), pa.array(sizes), *map(pa.array, sums), *lists_of],
            names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "tail", "tail_class"],
        )


def _frequent(counts: DataFrame, many: dict[int, int], limit: int) -> DataFrame:
    """About the ``limit`` most frequent words; of those that tie at the cut the share for which there is room, by hash."""
    total, least = 0, max(many, default=0) + 1
    for c in sorted(many, reverse=True):
        if total + many[c] > limit:
            room = int((limit - total) / many[c] * (1 << 20))
            return counts.filter((F.col("c") >= least) | ((F.col("c") == c) & (F.pmod(F.xxhash64("h"), F.lit(1 << 20)) < room)))
        total, least = total + many[c], c
    return counts


def _pairs(texts: DataFrame, number, n: int, end: int) -> np.ndarray:
    """The n x n counts of ``_bigrams`` over all texts."""
    rows = map_arrow(texts, lambda b: _bigrams(b, number, n, end), "unit int, data binary").repartition("unit")
    out = np.zeros((n, n))
    for r in map_arrow(rows, _add_rows, "unit int, data binary").toLocalIterator():
        out[r.unit] = _unpacked(r.data)
    return out


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model of ``docs`` and the table ``h, ending, c`` of all word counts."""
    texts, context = docs.select("text"), docs.sparkSession.sparkContext
    every = written(map_arrow(texts, _count, "h bigint, ending int, n bigint").groupBy("h").agg(F.min("ending").alias("ending"), F.sum("n").alias("c")))
    counts = every.filter("h IS NOT NULL")
    ends = every.filter("h IS NULL").agg(F.sum("c")).first()[0] or 0
    many = {r.c: r["count"] for r in counts.groupBy("c").count().collect()}  # different counts: at most about the root of twice the tokens
    n, v = sum(c * m for c, m in many.items()) + ends, sum(many.values()) + (ends > 0)
    head = _frequent(counts, many, CLASSED).select("h", "c", "ending").toArrow()
    h, c, ending = (x.to_numpy() for x in head.columns)
    order = np.argsort(h)
    h, c, ending = h[order], c[order], ending[order]
    units = Units(np.sort(h[np.lexsort((h, -c))[:CORE]]))  # of words that tie at the cut those of least hash

    size = units.end + 1
    pairs = _pairs(texts, units.of, size, units.end)
    label = exchange(pairs)
    # the class of each head word: of core words their unit's, of others their own contexts', of those that are too rare their ending's
    core = _place(units.core, h)[1]
    own = label[units.of(h, ending)]
    k = int(label.max()) + 1
    if k > 1:
        member = np.zeros((size, k))
        member[np.arange(size), label] = 1
        joint = member.T @ pairs @ member
        choosing = h[~core & (c >= OWN)]
        fixed = context.broadcast((label, choosing))
        rows = map_arrow(texts, lambda b: _contexts(b, units, *fixed.value), "h bigint, data binary").repartition("h").sortWithinPartitions("h")
        to = np.log((joint + DELTA) / (joint.sum(1, keepdims=True) + DELTA * k))
        weight = np.log(joint.sum(0) + DELTA)
        found = map_arrow(rows, lambda b: _choose(b, to, to.T.copy(), weight), "h bigint, class int").toArrow()  # at most CLASSED words
        own[np.searchsorted(h, found.column(0).to_numpy())] = found.column(1).to_numpy()
        shared = context.broadcast((units, label, h, own))
        joint = _pairs(texts, lambda h, e: _classes(h, e, *shared.value), k, int(label[units.end]))
    else:
        joint = np.zeros((k, k))
    share = (joint.sum(0) + DELTA) / (joint.sum() + DELTA * k)
    transition = np.log10((joint + PULL * share) / (joint.sum(1, keepdims=True) + PULL))
    # tokens and different words of each class: head words one by one, the others by ending
    tokens, kinds = np.bincount(own, c, k), np.bincount(own, minlength=k).astype(float)
    rest = counts.groupBy("ending").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect()  # RARE rows
    tail, tails = np.zeros(RARE), np.zeros(RARE)
    for r in rest:
        tail[r.ending], tails[r.ending] = r.c, r.n
    np.subtract.at(tail, ending, c)
    np.subtract.at(tails, ending, 1)
    by_ending = label[len(units.core) : units.end]
    tokens, kinds = tokens + np.bincount(by_ending, tail, k), kinds + np.bincount(by_ending, tails, k)
    emission = np.log10(tokens + DELTA * (kinds + 1))
    return Model(units, label, own, transition, emission, h, c, n, v, ends), counts


def score_documents(docs: DataFrame, training: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity`` for every row of ``docs`` (``doc_id, held_out, text``)."""
    model, counts = train(training)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: HEAD words and the unit tables
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row bigint, doc_id {kind}, held_out boolean, n_tokens bigint, known bigint, base double, score double, tail array<bigint>, tail_class array<int>"
    each = written(map_arrow(docs.select("doc_id", "held_out", "text"), lambda b: _score(b, shared.value), schema))
    tail = each.select("row", F.explode(F.arrays_zip("tail", "tail_class")).alias("t")).select("row", F.col("t.tail").alias("h"), F.col("t.tail_class").alias("class"))
    met = tail.join(counts.select("h", "c"), "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    denominators = F.split(F.lit(",".join(map(repr, model.emission.tolist()))), ",").cast("array<double>")
    base = F.log10((F.col("c") + DELTA) / F.lit(model.n + DELTA * (model.v + 1)))
    emit = F.log10(F.col("c") + DELTA) - F.get(denominators, F.col("class"))
    sums = met.groupBy("row").agg(F.sum((F.col("c") > 0).cast("long")).alias("more_known"), F.sum(base).alias("more_base"), F.sum(emit).alias("more_score"))
    joined = each.drop("tail", "tail_class").join(sums, "row", "left")
    score = F.col("score") + F.coalesce("more_score", F.lit(0.0))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(int(model.n)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        score.alias("score"),
        F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )


def op9_class_lm(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(part(F.col("doc_id"), 10) == 0, F.lit(False)).alias("held_out"))
    return score_documents(docs, docs.filter("NOT held_out"))
