"""Exact top-k by inner product over vectors sorted by norm.

Components become integers ``floor(scale * x)``. All vectors are rotated by the
singular directions of the corpus (from its d x d second-moment matrix, summed
over every row), so that leading coordinates carry most of the length. Vectors
are put in blocks of falling norm.

A first pass over the block of longest vectors gives every query the k-th best
score that it has so far, its floor. By Cauchy-Schwarz no vector shorter than
floor / norm of the query can come in, so queries are put in blocks by that
length and a query block only goes to the candidate blocks that hold longer
vectors: pairs of blocks beyond it are never made, and none of their data moves.
A candidate block travels once for GROUP query blocks, which stream past it. In
a pair of blocks exact scores of the longest candidates come first; then rotated
coordinates are added step by step, and a candidate falls out of a query's race
as soon as its partial sum plus the Cauchy-Schwarz bound on the rest cannot
reach the floor. Survivors are scored in integers. Rotated bounds are widened by
the rounding of double arithmetic, so no candidate within reach is lost. Each
pair of blocks gives at most k rows per query.

Vectors that are null or hold null or non-finite components take no part;
shorter vectors, empty ones too, count as zero-padded. Ties go to the smaller
id; rows with a null id take no part, and rows that repeat an id stay apart as
candidates (a query skips every row of its own id; of several query rows with
one id the least vector asks). Scores are exact. A component beyond 64 bits
after scaling, or a returned score beyond 64 bits, is an error. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bucket_of, map_arrow, numbers, table
from tessera.operators.storage import written

#: Vectors of a candidate block and of a query block; most levels that the driver draws bounds for.
BLOCK_ROWS, QUERY_ROWS, MOST_LEVELS = 1 << 13, 1 << 10, 1 << 16
#: Query blocks that pass one copy of a candidate block.
GROUP = 64
#: Rotated coordinates added per step, and candidates taken exactly before the first bound is used.
STEP, HEAD = 16, 512
#: Relative rounding that bounds allow for.
SLACK = 1e-9
NONE = np.iinfo(np.int64).min
WIDE = float(1 << 63)


def vectors(embeddings: DataFrame, scale: int) -> DataFrame:
    """``id, v`` (array of bigint) of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    sound = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))

    def whole(e: Column) -> Column:
        return F.when(F.abs(e * scale) < WIDE, F.floor(e * scale).cast("long")).otherwise(F.raise_error(F.concat(F.lit("component beyond 64 bits: "), e.cast("string"))).cast("long"))

    return embeddings.filter(F.coalesce(sound, F.lit(False))).select(F.col("vec_id").alias("id"), F.transform(x, whole).alias("v"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    sizes = np.asarray(column.value_lengths())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == d).all():
        return flat.reshape(-1, d)
    out = np.zeros((len(sizes), d), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(s) for s in sizes])] = flat
    return out


def _moments(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros((d, d))
    for batch in batches:
        v = _matrix(batch.column(0), d).astype(float)
        total += v.T @ v
    i, j = np.indices((d, d))
    yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "s"])


def _blocks(rows: DataFrame, value: str, each: int) -> tuple[DataFrame, list[tuple[int, int, float]]]:
    """``rows`` with ``block`` by falling ``value``, of about ``each`` rows, and the levels (first block, blocks, greatest value) by falling value.

    Rows of equal value are spread over as many blocks as they need, whatever else they share.
    """
    n = rows.count()
    count = max(1, min(MOST_LEVELS, -(-n // each)))
    bounds = sorted(set(rows.agg(F.percentile_approx(value, [i / count for i in range(1, count)], 10 * count)).first()[0])) if count > 1 else []
    level = F.lit(len(bounds)) - bucket_of(F.col(value), bounds, "double")
    found = {r.level: r for r in rows.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.max(value).alias("top")).collect()}
    levels, at = [], 0
    for i in range(len(bounds) + 1):
        wide = -(-found[i].n // each) if i in found else 0
        levels.append((at, wide, found[i].top if i in found else 0.0))
        at += wide
    first = F.element_at(numbers([s for s, _, _ in levels]), level + 1)
    spread = F.element_at(numbers([max(1, m) for _, m, _ in levels]), level + 1)
    return rows.withColumn("block", first + F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), spread)), levels


def _listed(v: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel()))


def _pack(rows: DataFrame, d: int) -> DataFrame:
    """``block, ids, data, floor``: each block's rows as binary values, by falling norm. A task holds one block."""

    def pack(batches):
        now, parts = None, []

        def row() -> pa.RecordBatch:
            ids, floor, v = (np.concatenate(x) for x in zip(*parts))
            data = [pa.array([x.astype("<i8").tobytes()], pa.binary()) for x in (ids, v, floor)]
            return pa.RecordBatch.from_arrays([pa.array([now]), *data], names=["block", "ids", "data", "floor"])

        for batch in batches:
            block, ids, floor = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            v = _matrix(batch.column(3), d) if len(block) else None
            for start, end in _runs(block):
                if block[start] != now:
                    if parts:
                        yield row()
                    now, parts = int(block[start]), []
                parts.append((ids[start:end], floor[start:end], v[start:end]))
        if parts:
            yield row()

    placed = rows.repartition("block").sortWithinPartitions("block", F.desc("norm"), "id").select(F.col("block").cast("long"), "id", "floor", "v")
    return map_arrow(placed, pack, "block bigint, ids binary, data binary, floor binary")


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    if len(values):
        cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
        yield from zip(np.append(0, cuts).tolist(), np.append(cuts, len(values)).tolist())


def _scores(q: np.ndarray, c: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Exact inner products of rows with rows, NONE where ``own``. Sums wrap at 64 bits, so they are right wherever the true one fits; the others are told by their size in doubles."""
    out = np.where(own, NONE, q @ c.T)
    fq, fc = q.astype(float), c.astype(float)
    rough = np.sqrt((fq**2).sum(1))[:, None] * np.sqrt((fc**2).sum(1))[None, :]
    if rough.size and rough.max() >= WIDE / 2:
        near = np.abs(fq @ fc.T) + SLACK * rough
        for i, j in zip(*np.nonzero((near >= WIDE) & ~own)):
            exact = sum(int(a) * int(b) for a, b in zip(q[i], c[j]))
            if exact >= 1 << 63:
                raise OverflowError(f"score beyond 64 bits: {exact}")
            out[i, j] = max(exact, NONE + 1)  # such a score is only returned where there are too few others
    return out


def _search(qi: np.ndarray, q: np.ndarray, ci: np.ndarray, c: np.ndarray, floor: np.ndarray, turn: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query that reach ``floor``: arrays of query index, candidate id, score."""
    head = min(HEAD, len(ci))
    own = qi[:, None] == ci[None, :head]
    scores = _scores(q, c[:head], own)
    if head >= k:
        floor = np.maximum(floor, np.partition(scores, head - k, axis=1)[:, head - k])
    hit = np.nonzero((scores >= floor[:, None]) & ~own)
    a, b, s = [hit[0]], [hit[1]], [scores[hit]]
    if len(ci) > head:
        rq, rc = q @ turn, c[head:] @ turn
        steps = range(0, turn.shape[1], STEP)
        tail_q = [np.sqrt((rq[:, i + STEP :] ** 2).sum(1)) for i in steps]
        tail_c = [np.sqrt((rc[:, i + STEP :] ** 2).sum(1)) for i in steps]
        norm_q, norm_c = np.sqrt((rq**2).sum(1)), np.sqrt((rc**2).sum(1))
        for i in range(len(q)):  # one query of a bounded block against the block's rest, by falling norm
            last = np.searchsorted(-norm_c, -(floor[i] / max(norm_q[i] * (1 + SLACK), 1e-300)), side="right") if floor[i] > 0 else len(norm_c)
            alive = np.arange(last)
            part = np.zeros(last)
            for t, j in enumerate(steps):
                part = part + rc[alive, j : j + STEP] @ rq[i, j : j + STEP]
                stay = part + tail_q[t][i] * tail_c[t][alive] + SLACK * norm_q[i] * norm_c[alive] + SLACK >= floor[i]
                alive, part = alive[stay], part[stay]
                if not len(alive):
                    break
            if len(alive):
                own = ci[head + alive] == qi[i]
                exact = _scores(q[i : i + 1], c[head + alive], own[None])[0]
                take = (exact >= floor[i]) & ~own
                a.append(np.full(take.sum(), i))
                b.append(head + alive[take])
                s.append(exact[take])
    a, b, s = np.concatenate(a), np.concatenate(b), np.concatenate(s)
    order = np.lexsort((ci[b], -s, a))
    a, b, s = a[order], b[order], s[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    return a[place < k], ci[b[place < k]], s[place < k]


def _unpacked(ids: bytes, data: bytes, d: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(data, "<i8").reshape(-1, d)


def _floors(batches: Iterator[pa.RecordBatch], block: tuple[bytes, bytes], d: int, turn: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """``id, v, norm, floor, reach`` from batches of ``id, v, norm``: the k-th best score within the longest block, and the length that a better vector must have."""
    ci, c = _unpacked(*block, d)
    for batch in batches:
        ids, norm = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        q = _matrix(batch.column(1), d)
        floor = np.full(len(ids), NONE)
        for i in range(0, len(ids), QUERY_ROWS):
            own = slice(i, i + QUERY_ROWS)
            a, _, s = _search(ids[own], q[own], ci, c, floor[own], turn, k)
            low = np.full(len(ids[own]), np.iinfo(np.int64).max)
            np.minimum.at(low, a, s)
            full = np.bincount(a, minlength=len(low)) >= k
            floor[own] = np.where(full, low, NONE)
        reach = np.where(floor > 0, floor / np.maximum(norm * (1 + SLACK), 1e-300), 0.0)
        yield pa.RecordBatch.from_arrays([batch.column(0), _listed(q), batch.column(2), pa.array(floor), pa.array(reach)], names=["id", "v", "norm", "floor", "reach"])


def _work(batches: Iterator[pa.RecordBatch], d: int, turn: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """From rows ``c, g, q, ids, data, floor`` sorted by them, of each ``c, g`` the candidate block first (q = -1): the best of each pair."""
    at, held = None, None
    for batch in batches:
        for r in batch.to_pylist():
            if r["q"] < 0:
                at, held = (r["c"], r["g"]), _unpacked(r["ids"], r["data"], d)
                continue
            if at != (r["c"], r["g"]):
                raise ValueError(f"no candidate block {r['c']}")
            qi, q = _unpacked(r["ids"], r["data"], d)
            a, b, s = _search(qi, q, *held, np.frombuffer(r["floor"], "<i8"), turn, k)
            if (s <= NONE + 1).any():
                raise OverflowError("score beyond 64 bits")
            yield pa.RecordBatch.from_arrays([pa.array(qi[a]), pa.array(b), pa.array(s)], names=["query_id", "vec_id", "score"])


def pairs_of_blocks(queries: DataFrame, levels: list[tuple[int, int, float]]) -> DataFrame:
    """``q, c``: each query block (``q, reach``) with the candidate blocks whose longest vector its least reach allows. Only numbers of blocks."""
    tops, ends = [t for _, n, t in levels if n], [s + n for s, n, _ in levels if n]
    met = F.size(F.filter(numbers(tops, "double"), lambda t: t * (1 + SLACK) >= F.col("reach")))
    last = F.element_at(numbers([0, *ends]), met + 1)
    return queries.select("q", F.explode(F.when(last > 0, F.sequence(F.lit(0).cast("long"), last - 1)).otherwise(F.array().cast("array<bigint>"))).alias("c"))


def top_k(embeddings: DataFrame, query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest inner products of each row that ``query`` selects with every row of another id."""
    spark = embeddings.sparkSession
    rows = written(vectors(embeddings, scale).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e))))
    d = rows.agg(F.max(F.size("v"))).first()[0]
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    if d is None:
        return spark.createDataFrame([], schema)
    d = max(1, d)
    summed = map_arrow(rows.select("v"), lambda b: _moments(b, d), "i bigint, j bigint, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    gram = np.zeros((d, d))
    for r in summed.collect():  # d x d numbers
        gram[r.i, r.j] = r.s
    turn = np.linalg.eigh(gram)[1][:, ::-1].copy()

    placed, levels = _blocks(rows, "norm", BLOCK_ROWS)
    candidates = written(_pack(placed.withColumn("floor", F.lit(NONE).cast("long")), d))
    asking = rows.filter(query).groupBy("id").agg(F.min(F.struct("v", "norm")).alias("r")).select("id", "r.v", "r.norm")
    longest = candidates.filter("block = 0").select("ids", "data").first()  # BLOCK_ROWS vectors
    shared = spark.sparkContext.broadcast((bytes(longest.ids), bytes(longest.data)))
    floors = map_arrow(asking, lambda b: _floors(b, shared.value, d, turn, k), "id bigint, v array<bigint>, norm double, floor bigint, reach double")
    dealt, _ = _blocks(written(floors), "reach", QUERY_ROWS)
    queries = written(_pack(dealt, d).withColumnRenamed("block", "q"))
    least = dealt.groupBy(F.col("block").cast("long").alias("q")).agg(F.min("reach").alias("reach"))
    pairs = written(pairs_of_blocks(least, levels).withColumn("g", F.floor(F.col("q") / GROUP)))

    asked = pairs.join(queries, "q").select("c", "g", "q", "ids", "data", "floor")
    met = pairs.select("c", "g").distinct().join(candidates, F.col("c") == F.col("block")).select("c", "g", F.lit(-1).cast("long").alias("q"), "ids", "data", "floor")
    tasks = pairs.agg(F.count_distinct("c", "g")).first()[0]
    work = asked.union(met).repartition(max(1, min(tasks, 4096)), "c", "g").sortWithinPartitions("c", "g", "q")
    found = map_arrow(work, lambda b: _work(b, d, turn, k), "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk_inner_product(spark, sf_dir) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


OP10_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])), 0)::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
