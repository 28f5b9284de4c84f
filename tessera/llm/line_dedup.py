"""Near-duplicate lines by a segment-partition edit join.

Two lines of at least ``min_length`` code points link when their edit distance
is at most ``threshold``. Every distinct line is cut into threshold + 1 even
segments. If two lines link, some segment of the shorter one occurs in the
longer one, near its own place; the multi-match windows say where it can start
for each length difference. So a line enters the index under its segments
(keyed by length, segment number and content) and probes the index for its own
length and the ``threshold`` lengths below.

The join runs on hashes in two passes, and no step emits all pairs of a group:

1. Keys meet by hash. A row carries the line's hash and a 64-bit parity
   signature of its symbols (one edit changes at most two bits), so lines that
   share a segment but cannot link fall out here. A row, not a pair, comes out:
   the line and the key under which it has a possible partner.
2. Only those rows get their text. Within a key, lines are taken in order of
   first occurrence, and each is verified by banded bit-parallel edit distance
   against possible earlier partners until one links. A key of more than MANY
   lines goes without the signatures; what all its lines begin and end with is
   taken off (which changes no distance), and what is left is cut into segments
   again, so a very common passage with a varying rest costs a few rows a line
   and not its pairs.

A line is a repeat when the same line, or one that links to it, occurs earlier
in order of (doc_id, line number). Lines shorter than ``min_length`` repeat by
equality only if they have at least ``exact_length`` code points; blank and very
short lines are never removed.

Null texts have no lines. Ids may be null (first in order); rows that repeat an
id are told apart by their text, and equal rows count as one row. Other columns
are carried along. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import let, map_arrow, table
from tessera.operators.storage import written

THRESHOLD, MIN_LENGTH, EXACT_LENGTH = 2, 30, 20
#: Rows of a key whose signatures are compared; a key of more is cut into segments again, this often at most.
MANY, DEPTH = 2048, 4
#: Lines that are not cut into segments; lines with a segment in common that are cut again rather than paired.
FEW, CROWD = 24, 256
#: Symbols, and pairs of signatures, that are compared at once.
AT_ONCE = 1 << 21
#: 64-bit words of the filter that tells which lines need their text: 16 MB whatever the input.
FILTER_WORDS = 1 << 21
#: Line hashes that a task remembers.
SENT = 400_000


def segments(n: int, threshold: int) -> list[tuple[int, int]]:
    """(start, length) of the even segments of a line of n symbols; the last ones are longer."""
    k = threshold + 1
    base, longer = divmod(n, k)
    out, at = [], 0
    for i in range(k):
        size = base + (i >= k - longer)
        out.append((at, size))
        at += size
    return out


def windows(length: int, shorter: int, threshold: int) -> list[tuple[int, int, int, int]]:
    """(segment, its length, first start, last start): where segments of a line of ``shorter`` symbols can lie in one of ``length``."""
    delta, out = length - shorter, []
    for i, (p, size) in enumerate(segments(shorter, threshold)):
        low = max(0, p - i, p + delta - (threshold - i))
        high = min(length - size, p + i, p + delta + (threshold - i))
        if low <= high:
            out.append((i, size, low, high))
    return out


def edit_distance_within(a: str, b: str, k: int) -> int | None:
    """The edit distance of a and b if it is at most k: bit-parallel rows of which only the 2k+1 diagonal bits around the band are kept."""
    if abs(len(a) - len(b)) > k:
        return None
    n = min(len(a), len(b))
    i = 0
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if not a or not b:
        d = max(len(a), len(b))
        return d if d <= k else None
    # reach[e]: bit d + k is set if, with e edits, some prefix pair (x, x + d) is reached at the present symbol of a
    width = 2 * k + 1
    full = (1 << width) - 1

    def spread(e: list[int]) -> list[int]:
        """What fewer edits reach, and insertions: the diagonal moves up at one edit each."""
        for d in range(1, k + 1):
            e[d] |= e[d - 1] | (e[d - 1] << 1) & full
        return e

    reach = spread([1 << k] + [0] * k)
    for x, c in enumerate(a):
        same = 0
        for d in range(-k, k + 1):
            if 0 <= x + d < len(b) and b[x + d] == c:
                same |= 1 << (d + k)
        inside = 0
        for d in range(-k, k + 1):
            if x + 1 + d <= len(b) and x + 1 + d >= 0:
                inside |= 1 << (d + k)
        new = [reach[0] & same]
        for e in range(1, k + 1):
            new.append((reach[e] & same) | reach[e - 1] | (reach[e - 1] >> 1))
        reach = spread([r & inside for r in new])
        reach = [r & inside for r in reach]
        if not reach[k]:
            return None
    end = len(b) - len(a) + k
    for e in range(k + 1):
        if reach[e] >> end & 1:
            return e
    return None


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.int32)


def within_many(a: str, others: list[str], k: int) -> np.ndarray:
    """For each other string whether its edit distance to ``a`` is at most k."""
    return _within(_codes(a)[None, :], others, k)


def _within(own: np.ndarray, others: list[str], k: int) -> np.ndarray:
    """For each other string whether its edit distance to its row of ``own`` (or the only one) is at most k: the rows of :func:`edit_distance_within` for all at once."""
    n, size = own.shape[1], np.array([len(b) for b in others])
    out = np.abs(size - n) <= k
    at = np.flatnonzero(out)
    if not len(at) or not n:
        return out
    size = size[at]
    own = own if len(own) == 1 else own[at]
    wide = n + 3 * k
    codes = np.full((len(at), wide), -1, np.int32)
    inner = np.arange(wide)[None, :] - k
    codes[(inner >= 0) & (inner < size[:, None])] = _codes("".join(others[i] for i in at))
    kind = np.uint8 if k <= 3 else np.uint32
    same = np.zeros((n, len(at)), kind)
    for d in range(2 * k + 1):
        same |= (codes[:, d : d + n] == own).T.astype(kind) << kind(d)
    full = kind((1 << (2 * k + 1)) - 1)
    reach = [np.full(len(at), 1 << k, kind), *(np.zeros(len(at), kind) for _ in range(k))]

    def spread(e: list[np.ndarray]) -> list[np.ndarray]:
        for d in range(1, k + 1):
            e[d] |= e[d - 1] | (e[d - 1] << kind(1)) & full
        return e

    reach = spread(reach)
    places = np.arange(2 * k + 1) - k
    for x in range(n):
        new = [reach[0] & same[x]]
        for e in range(1, k + 1):
            new.append((reach[e] & same[x]) | reach[e - 1] | (reach[e - 1] >> kind(1)))
        if x + 1 <= k or x + 1 + k >= n - k:  # near the ends of the shorter strings some diagonals do not exist
            inside = (((places + x + 1 >= 0)[None, :] & (places[None, :] + x + 1 <= size[:, None])).astype(kind) << np.arange(2 * k + 1, dtype=kind)).sum(axis=1, dtype=kind)
            reach = [r & inside for r in spread([r & inside for r in new])]
        else:
            reach = spread(new)
        if x % 16 == 15:  # pairs that are out go
            alive = np.flatnonzero(reach[k])
            if 2 * len(alive) < len(at):
                out[np.delete(at, alive)] = False
                at, size, same, reach = at[alive], size[alive], same[:, alive], [r[alive] for r in reach]
                if not len(at):
                    return out
    out[at] = reach[k] >> (size - n + k).astype(kind) & kind(1) != 0
    return out


def _link_pairs(lines: list[str], first: np.ndarray, later: np.ndarray, distance: np.ndarray, threshold: int, linked: np.ndarray, rows: np.ndarray) -> None:
    """Sets ``linked`` at the later line of each pair that links: the pairs of nearest signatures first, further ones of lines that have no link yet."""
    order = np.lexsort((first, distance, later))
    first, later = first[order], later[order]
    start = np.flatnonzero(np.concatenate([[True], later[1:] != later[:-1]]))
    rank = np.arange(len(later)) - np.repeat(start, np.diff(np.append(start, len(later))))
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    low, high = 0, 1
    while low < len(later):
        some = np.flatnonzero((rank >= low) & (rank < high) & ~linked[rows[later]])
        if not len(some) and high > rank.max():
            return
        some = some[np.argsort(size[first[some]], kind="stable")]
        for length in np.unique(size[first[some]]).tolist():
            own = some[size[first[some]] == length]
            step = max(1, AT_ONCE // max(1, length))
            for i in range(0, len(own), step):
                pairs = own[i : i + step]
                a = _codes("".join(lines[x] for x in first[pairs])).reshape(len(pairs), length)
                hit = _within(a, [lines[x] for x in later[pairs]], threshold)
                linked[rows[later[pairs[hit]]]] = True
        low, high = high, 4 * high


def _common(lines: list[str]) -> tuple[int, int]:
    """How many symbols all lines begin with, and end with after those."""

    def shared(a: str, b: str) -> int:
        n = min(len(a), len(b))
        return next((i for i in range(n) if a[i] != b[i]), n)

    first = shared(min(lines), max(lines))
    turned = [x[::-1] for x in lines]
    return first, min(shared(min(turned), max(turned)), min(map(len, lines)) - first)


def _plan(n: int, threshold: int, least: int) -> tuple[list, list]:
    """(length, segment, its length, start) under which a line of n symbols is found, and under which it seeks others."""
    index = [(n, i, size, p) for i, (p, size) in enumerate(segments(n, threshold))]
    probes = [(n - d, i, size, p) for d in range(threshold + 1) if n - d >= least for i, size, low, high in windows(n, n - d, threshold) for p in range(low, high + 1)]
    return index, [x for x in probes if x not in set(index)]


def mark_links(lines: list[str], threshold: int, linked: np.ndarray, rows: np.ndarray, depth: int = DEPTH) -> None:
    """Sets ``linked`` at each of ``rows`` (ascending; ``lines`` are theirs, all different) that links to an earlier one."""
    n = len(lines)
    if n < 2 or linked[rows[1:]].all():
        return
    if n > FEW and depth:
        first, last = _common(lines)
        lines = [x[first : len(x) - last] for x in lines]
        if max(map(len, lines)) <= threshold:
            linked[rows[1:]] = True
            return
        plans: dict[int, tuple[list, list]] = {}
        met: dict[tuple, list[int]] = {}
        short = min(map(len, lines)) <= threshold
        for i, x in enumerate(lines):
            size = len(x)
            if short and size <= 2 * threshold:
                met.setdefault((), []).append(i)
            if size > threshold:
                if size not in plans:
                    plans[size] = _plan(size, threshold, threshold + 1)
                for items in plans[size]:
                    for length, number, wide, p in items:
                        met.setdefault((length, number, x[p : p + wide]), []).append(i)
        groups: dict[int, list[list[int]]] = {}
        for own in met.values():
            own = sorted(set(own)) if len(own) > 1 else own
            if len(own) > 1:
                groups.setdefault(len(own), []).append(own)
        del met
        if n in groups:  # a segment of all: cutting does not tell them apart
            groups = {n: groups[n][:1]}
        sig = np.array([signature(x) for x in lines], np.uint64)
        found = []
        for size, some in sorted(groups.items()):
            if CROWD < size < n:
                for own in some:
                    mark_links([lines[i] for i in own], threshold, linked, rows[own], depth - 1)
                continue
            same = np.unique(np.array(some), axis=0)
            if size > FEW:
                for own in same:
                    _link_near(lines, sig, own, threshold, linked, rows)
                continue
            a, b = np.triu_indices(size, 1)
            step = max(1, AT_ONCE // len(a))
            for i in range(0, len(same), step):
                first, later = same[i : i + step, a].ravel(), same[i : i + step, b].ravel()
                keep = (np.bitwise_count(sig[first] ^ sig[later]) <= 2 * threshold) & ~linked[rows[later]]
                found.append(np.unique(later[keep] * n + first[keep]))
        pairs = np.unique(np.concatenate([*found, np.zeros(0, np.int64)]))
        if len(pairs):
            later, first = np.divmod(pairs, n)
            _link_pairs(lines, first, later, np.bitwise_count(sig[first] ^ sig[later]), threshold, linked, rows)
        return
    _link_near(lines, np.array([signature(x) for x in lines], np.uint64), np.arange(n), threshold, linked, rows)


def _link_near(lines: list[str], sig: np.ndarray, members: np.ndarray, threshold: int, linked: np.ndarray, rows: np.ndarray) -> None:
    """Compares each of ``members`` (ascending) that has no link yet with all earlier ones of near signature."""
    own = sig[members]
    step = max(1, AT_ONCE // len(members))
    for i in range(0, len(members), step):
        later = np.arange(i, min(i + step, len(members)))
        later = later[~linked[rows[members[later]]]]
        distance = np.bitwise_count(own[later][:, None] ^ own[None, : i + step])
        y, x = np.nonzero((distance <= 2 * threshold) & (np.arange(distance.shape[1])[None, :] < later[:, None]))
        if len(y):
            _link_pairs(lines, members[x], members[later[y]], distance[y, x], threshold, linked, rows)


def signature(line: str) -> int:
    """Parities of the symbols, in 64 buckets."""
    out = 0
    for c in set(line):
        if line.count(c) & 1:
            out ^= 1 << (ord(c) * 0x9E37 >> 3 & 63)
    return out


def _hash(data: str) -> int:
    return xxhash.xxh3_64_intdigest(data.encode("utf-8", "surrogatepass")) - (1 << 63)


def _lines(batches: Iterator[pa.RecordBatch], exact: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc, key, number, h, size = [], [], [], [], []
        for d, k, text in zip(*(c.to_pylist() for c in batch.columns)):
            for i, line in enumerate((text or "").split("\n")):
                if len(line) >= exact:
                    doc.append(d)
                    key.append(k)
                    number.append(i)
                    h.append(_hash(line))
                    size.append(len(line))
        kind = batch.column(0).type
        yield pa.RecordBatch.from_arrays([pa.array(doc, kind), pa.array(key, pa.int64()), pa.array(number, pa.int32()), pa.array(h, pa.int64()), pa.array(size, pa.int32())], names=["doc_id", "doc_key", "line", "h", "size"])


def _texts(batches: Iterator[pa.RecordBatch], least: int, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each batch's distinct lines by hash, of those whose bit is set."""
    for batch in batches:
        found = {_hash(line): line for text in batch.column(0).to_pylist() for line in (text or "").split("\n") if len(line) >= least}
        h = np.array(list(found), np.int64)
        maybe = bits[(h >> 6) & (FILTER_WORDS - 1)].view(np.uint64) >> (h & 63).astype(np.uint64) & np.uint64(1)
        found = {x: found[x] for x in h[maybe.astype(bool)].tolist()}
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.string())], names=["h", "text"])


def _keys(batches: Iterator[pa.RecordBatch], threshold: int, least: int) -> Iterator[pa.RecordBatch]:
    """``key, h, sig`` of the segments and substrings of each batch's distinct lines. The lowest bits of h say whether the row is in the index, probes, or both."""
    seen: dict[int, tuple[list, list]] = {}
    digest = xxhash.xxh3_64_intdigest
    sent: set[int] = set()  # lines that this task has sent; forgetting some only costs repeated rows
    for batch in batches:
        lines = {line for text in batch.column(0).to_pylist() for line in (text or "").split("\n") if len(line) >= least}
        key, h, sig, role = [], [], [], []
        for line in lines:
            own = _hash(line)
            if own in sent:
                continue
            sent.add(own)
            s = signature(line)
            if len(line) not in seen:
                seen[len(line)] = _plan(len(line), threshold, least)
            index, probes = seen[len(line)]
            for r, items in ((3, index), (1, probes)):
                for length, i, size, p in items:
                    key.append(digest(line[p : p + size].encode("utf-8", "surrogatepass"), length * 8 + i))
                    role.append(r)
            h += [own] * (len(index) + len(probes))
            sig += [s] * (len(index) + len(probes))
        if len(sent) > SENT:
            sent.clear()
        # bit 0: probes; bit 1: in the index. They replace the lowest key bits.
        k = (np.array(key, np.uint64) & ~np.uint64(3)) | np.array(role, np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(h, pa.int64()), pa.array(np.array(sig, np.uint64).view(np.int64))], names=["key", "h", "sig"])


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Runs of equal first column over sorted batches, several whole runs at a time."""
    kept: list[dict] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append({n: c.to_numpy(zero_copy_only=False) for n, c in zip(names, batch.columns)})
        last = kept[-1][names[0]][-1]
        if kept[0][names[0]][0] == last:
            continue
        whole = {n: np.concatenate([k[n] for k in kept]) for n in names}
        cut = np.flatnonzero(whole[names[0]] != last)[-1] + 1
        kept = [{n: v[cut:] for n, v in whole.items()}]
        yield {n: v[:cut] for n, v in whole.items()}
    if kept:
        yield {n: np.concatenate([k[n] for k in kept]) for n in names}


def _possible(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key without its role: the rows that have a possible partner under their key."""
    for rows in _groups(batches, ["at", "role", "h", "sig"]):
        at, role, h, sig = (rows[n] for n in ("at", "role", "h", "sig"))
        sig = sig.view(np.uint64)
        start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        end = np.append(start[1:], len(at))
        many = end - start > 1
        keep = np.zeros(len(at), bool)
        for s, e in zip(start[many], end[many]):
            if (h[s:e] == h[s]).all():
                continue
            if e - s > MANY:
                keep[s:e] = True
                continue
            own = slice(s, e)
            near = np.bitwise_count(sig[own][:, None] ^ sig[own][None, :]) <= 2 * threshold
            near &= (h[own][:, None] != h[own][None, :]) & ((role[own] & 2 != 0)[:, None] | (role[own] & 2 != 0)[None, :])
            keep[own] = near.any(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(at[keep]), pa.array(h[keep])], names=["at", "h"])


def _verify(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key and first occurrence: the hashes of lines that link to an earlier one."""
    for rows in _groups(batches, ["at", "place", "h", "text"]):
        at, h, text = rows["at"], rows["h"], rows["text"]
        start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        linked = np.zeros(len(at), bool)
        for s, e in zip(start, np.append(start[1:], len(at))):
            own = s + np.sort(np.unique(h[s:e], return_index=True)[1])
            mark_links(text[own].tolist(), threshold, linked, own)
        yield pa.RecordBatch.from_arrays([pa.array(h[linked])], names=["h"])


def _filter_bits(hashes: DataFrame) -> np.ndarray:
    """A bit for each hash, of FILTER_WORDS * 64. Only what passes is shuffled; what passes by chance goes in the join."""
    words = hashes.select(F.shiftright("h", 6).bitwiseAND(F.lit(FILTER_WORDS - 1)).alias("w"), F.expr("shiftleft(1L, cast(h & 63 AS int))").alias("b"))
    set_ = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(FILTER_WORDS, np.int64)
    out[set_.column(0).to_numpy()] = set_.column(1).to_numpy()
    return out


def repeats(docs: DataFrame, threshold: int = THRESHOLD, min_length: int = MIN_LENGTH, exact_length: int = EXACT_LENGTH) -> DataFrame:
    """``doc_id, doc_key, line, near``: lines of ``docs`` that repeat an earlier one, equally (near = false) or within the threshold. ``doc_key`` hashes the text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.xxhash64("text").alias("doc_key"), "text")
    lines = written(map_arrow(keyed, lambda b: _lines(b, exact_length), f"doc_id {kind}, doc_key bigint, line int, h bigint, size int"))
    place = F.struct("doc_id", "doc_key", "line")
    firsts = lines.groupBy("h").agg(F.min(place).alias("place"), F.max("size").alias("size"), F.count(F.lit(1)).alias("n"))

    texts = docs.select("text")
    keys = map_arrow(texts, lambda b: _keys(b, threshold, min_length), "key bigint, h bigint, sig bigint")
    at = F.shiftrightunsigned("key", 2)
    keyed_rows = keys.repartition(at).select(at.alias("at"), F.col("key").bitwiseAND(F.lit(3)).cast("int").alias("role"), "h", "sig").sortWithinPartitions("at")
    possible = written(map_arrow(keyed_rows, lambda b: _possible(b, threshold), "at bigint, h bigint").distinct())
    wanted = possible.select("h").distinct()
    bits = docs.sparkSession.sparkContext.broadcast(_filter_bits(wanted))  # of fixed size
    line_texts = map_arrow(texts, lambda b: _texts(b, min_length, bits.value), "h bigint, text string").join(wanted, "h", "left_semi").groupBy("h").agg(F.min("text").alias("text"))
    placed = line_texts.join(firsts.select("h", "place"), "h")
    told = possible.join(placed, "h").select("at", F.struct(F.col("place.doc_id").alias("a"), F.col("place.doc_key").alias("b"), F.col("place.line").alias("c")).alias("place"), "h", "text")
    order = told.repartition("at").sortWithinPartitions("at", "place", "h").select("at", F.lit(0).alias("place"), "h", "text")
    near = written(map_arrow(order, lambda b: _verify(b, threshold), "h bigint").distinct())

    # written, so that both sides of the join below are plain exchanges and a very common line's partition can be split
    marked = firsts.join(near.withColumn("near", F.lit(True)), "h", "left").filter("near OR n > 1").select("h", F.col("place").alias("first"), F.coalesce("near", F.lit(False)).alias("near"))
    marked = written(marked)
    repeated = lines.join(marked, "h").filter(F.col("near") | ~place.eqNullSafe(F.col("first")))
    return repeated.select("doc_id", "doc_key", "line", "near").distinct()


def without_repeats(docs: DataFrame, threshold: int = THRESHOLD, min_length: int = MIN_LENGTH, exact_length: int = EXACT_LENGTH) -> DataFrame:
    """``row, clean, removed``: each row of ``docs``, its text without repeated lines, and how many went."""
    gone = repeats(docs, threshold, min_length, exact_length).groupBy("doc_id", "doc_key").agg(F.collect_set("line").alias("lines"))
    gone = gone.select(F.col("doc_id").alias("id"), "doc_key", "lines")
    packed = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("key"))
    joined = packed.join(gone, F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("doc_key")), "left")
    def without(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "lines")
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    clean = F.when(F.col("lines").isNull(), F.col("row.text")).otherwise(let(F.split("row.text", "\n"), without))
    return joined.select("row", clean.alias("clean"), F.coalesce(F.size("lines"), F.lit(0)).alias("removed"))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without repeated lines; ``n_chars`` follows the text, and texts of which nothing is left go."""
    done = without_repeats(docs, **options).filter("NOT (removed > 0 AND trim(clean) = '')")
    row = F.col("row").withField("text", F.col("clean"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("clean").cast(docs.schema["n_chars"].dataType))
    return done.select(row.alias("row")).select("row.*")


def op5_line_dedup(spark, sf_dir) -> DataFrame:
    """``doc_id, n_lines, removed, clean_sha256`` of every document."""
    done = without_repeats(table(spark, sf_dir, "documents"))
    lines = F.when(F.col("row.text").isNull(), 0).otherwise(F.size(F.split("row.text", "\n"))).cast("long")
    return done.select(F.col("row.doc_id").alias("doc_id"), lines.alias("n_lines"), F.col("removed").cast("long").alias("removed"), F.sha2(F.coalesce("clean", F.lit("")), 256).alias("clean_sha256"))
