"""Mixing sources to target weights by hash-threshold histograms.

Every document gets a fixed 48-bit hash. For each source the mix takes whole
copies of everything as often as its target allows, then the documents below
one hash threshold. The threshold is found by nested histograms: sizes are
summed by source and leading hash bits, the bucket in which the budget ends is
found, and only that bucket is split by the next bits. Nothing is sorted and
the decision for one document depends on its own hash alone, so reruns agree.

Null text has size 0; a null source is a source of its own, last in order;
null ids hash as the empty string; rows that repeat an id are taken together;
an empty table gives an empty mix. Other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import local_frame, table, word_count
from tessera.operators.storage import written

#: Bits of the hash, in levels of LEVEL_BITS.
HASH_BITS, LEVEL_BITS = 48, 12


@dataclass(frozen=True)
class SourcePlan:
    source: str | None
    size: int
    target: float
    copies: int
    threshold: int


def water_fill(sizes: dict[str | None, int], weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> dict[str | None, float]:
    """Targets by source: weights repeat over the sources by code point (null last); no target is above ``cap`` times its source's size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, targets = share * sum(sizes.values()), order, dict.fromkeys(order, 0.0)
    while free:
        unit = left / sum(weight[s] for s in free)
        above = [s for s in free if weight[s] * unit > cap * sizes[s]]
        if not above:
            targets |= {s: weight[s] * unit for s in free}
            break
        targets |= {s: cap * sizes[s] for s in above}
        left -= sum(cap * sizes[s] for s in above)
        free = [s for s in free if s not in above]
    return targets


def hash48(key: Column) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    return docs.select(
        F.col(key).alias("doc_id"),
        F.col(source).alias("source"),
        word_count(F.col(text)).alias("size"),
        hash48(F.col(key)).alias("h"),
    )


def plan_mix(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> list[SourcePlan]:
    """One row per source reaches the driver; documents never do."""
    spark = sizes.sparkSession
    totals = {r.source: r.size for r in sizes.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    targets = water_fill(totals, weights, share, cap)
    copies = {s: int(targets[s] // n) if n else 0 for s, n in totals.items()}
    budget = {s: targets[s] - copies[s] * n for s, n in totals.items()}
    prefix = dict.fromkeys((s for s, n in totals.items() if n), 0)
    threshold = dict.fromkeys(totals, 0)
    shift = HASH_BITS
    while shift and prefix:
        outer, shift = shift, shift - LEVEL_BITS
        state = local_frame(spark, [(s, p) for s, p in prefix.items()], "open string, prefix long")
        inside = sizes.join(state, F.col("source").eqNullSafe(F.col("open")) & (F.shiftright("h", outer) == F.col("prefix")))
        bucket = F.shiftright("h", shift).alias("bucket")
        buckets = inside.groupBy("source", bucket).agg(F.sum("size").alias("size"))
        folded = buckets.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("bucket", "size"))).alias("buckets"))  # at most 2^LEVEL_BITS in a source
        found = {}
        limits = local_frame(spark, [(s, budget[s]) for s in prefix], "open string, budget double")
        walk = F.aggregate(
            "buckets",
            F.struct(F.lit(0).cast("long").alias("below"), F.lit(None).cast("long").alias("bucket"), F.lit(0).cast("long").alias("size")),
            lambda a, b: F.when(a["bucket"].isNotNull(), a)
            .when(a["below"] + b["size"] > F.col("budget"), F.struct(a["below"].alias("below"), b["bucket"].alias("bucket"), b["size"].alias("size")))
            .otherwise(F.struct((a["below"] + b["size"]).alias("below"), F.lit(None).cast("long").alias("bucket"), F.lit(0).cast("long").alias("size"))),
        )
        for r in folded.join(limits, F.col("source").eqNullSafe(F.col("open"))).select("source", walk.alias("w")).collect():
            found[r.source] = r.w
        for s in list(prefix):
            w = found.get(s)
            if w is None or w.bucket is None:  # the whole open range fits
                threshold[s] = (prefix.pop(s) + 1) << outer
                continue
            budget[s] -= w.below
            prefix[s] = w.bucket
            if not shift:  # one hash value is left: take it if that ends nearer the target
                threshold[s] = w.bucket + (2 * budget[s] >= w.size)
    return [SourcePlan(s, n, targets[s], copies[s], threshold[s]) for s, n in totals.items()]


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` for every row of ``docs``."""
    sizes = written(sized(docs))
    plan = plan_mix(sizes, weights, share, cap)
    rows = [(p.source, p.size, p.target, p.copies, p.threshold) for p in plan]
    state = local_frame(docs.sparkSession, rows, "of string, source_size long, target double, whole int, threshold long")
    copies = F.col("whole") + (F.col("h") < F.col("threshold")).cast("int")
    return sizes.join(state, F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    plan = plan_mix(written(sized(docs)), weights, share, cap)
    state = local_frame(docs.sparkSession, [(p.source, p.copies, p.threshold) for p in plan], "of string, whole int, threshold long")
    hashed = docs.select(F.struct("*").alias("row"), F.col("source"), hash48(F.col("doc_id")).alias("h"))
    copies = F.col("whole") + (F.col("h") < F.col("threshold")).cast("int")
    joined = hashed.join(state, F.col("source").eqNullSafe(F.col("of"))).withColumn("copies", copies).filter("copies > 0")
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op8_mix_sources(spark, sf_dir) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS n,
         CASE (row_number() OVER (ORDER BY source COLLATE C NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, 2.0::DOUBLE * n / w AS ratio,
         coalesce(sum(2.0::DOUBLE * n) OVER (ORDER BY 2.0::DOUBLE * n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(w) OVER (ORDER BY 2.0::DOUBLE * n / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free_w,
         sum(n) OVER () * 1.5::DOUBLE AS share
  FROM s),
u AS (SELECT arg_min((share - capped) / free_w, ratio) FILTER (WHERE (share - capped) / free_w <= ratio) AS unit FROM o),
t AS (
  SELECT source, n, CASE WHEN w * unit > 2.0::DOUBLE * n THEN 2.0::DOUBLE * n ELSE w * unit END AS target
  FROM o, u),
c AS (
  SELECT d.*, t.n, t.target, CASE WHEN t.n > 0 THEN floor(t.target / t.n) ELSE 0 END AS whole,
         sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(size) OVER (PARTITION BY d.source, h) AS own
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, n AS source_size, target,
       (size * (whole + CASE WHEN upto <= target - whole * n THEN 1
                             WHEN upto - own <= target - whole * n AND 2 * (target - whole * n - (upto - own)) >= own THEN 1
                             ELSE 0 END))::BIGINT AS taken
FROM c
"""
