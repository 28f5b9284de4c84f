"""SimHash near-duplicates: fingerprints of word shingles, linked by Gray-ordered indexes.

A text is lower-cased in A-Z and cut into words at ASCII white space; every run
of ``width`` words (the whole text if it is shorter) votes with its XXH64.
Null texts and texts without words have fingerprint zero and are linked like
any other. Repeated rows share a fingerprint and so a component. Null ids take
no part in naming components (a component of null ids alone has a null name).
Other columns are ignored, empty tables give empty results. Copies are folded
into one fingerprint before linking, so a group of copies of any size costs one
row there.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, table
from tessera.llm.components import components
from tessera.llm.gray_index import hamming_links
from tessera.operators.storage import written

SEED = 42
#: Shingles whose bits are unpacked at once.
AT_ONCE = 1 << 16


def majority(hashes: np.ndarray) -> int:
    """The signed 64-bit pattern of the bits that over half the hashes have; zero if there are none."""
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), AT_ONCE):
        some = hashes[i : i + AT_ONCE]
        votes += np.unpackbits(some.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * votes > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def simhash(text: str | None, width: int = 3) -> int:
    """The signed 64-bit fingerprint of one text."""
    words = (text or "").encode().lower().split()  # on bytes: A-Z only, ASCII white space
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    ends = list(accumulate((len(w) + 1 for w in words)))
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_intdigest
    k = min(width, n)
    hashes = np.fromiter((digest(joined[s : e - 1], SEED) for s, e in zip(starts, ends[k - 1 :])), np.uint64, n - k + 1)
    return majority(hashes)


def _fingerprint(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [simhash(t.as_py(), width) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id, fp`` (signed bit pattern) for every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), lambda batches: _fingerprint(batches, width), f"doc_id {kind}, fp bigint")


def near_duplicates(docs: DataFrame, radius: int = 3, width: int = 3) -> DataFrame:
    """``doc_id, fp, component_id`` for every row; the component is named by its smallest document."""
    each = written(fingerprints(docs, width))
    distinct = written(each.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = components(hamming_links(distinct, radius))
    # named: fingerprints that are linked to others, with the smallest document of their component
    member = roots.select("root", F.col("node").alias("fp")).union(roots.select("root", "root").distinct())
    member = member.join(distinct, "fp")
    named = member.join(member.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("fp", "component_id")
    name = distinct.join(named, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    # written, so that both sides of this join are plain exchanges and the partition of a very common text can be split
    return each.join(written(name), "fp").select("doc_id", "fp", "component_id")


def hex64(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def survivors(docs: DataFrame, each: DataFrame, links: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component: the one of least id (nulls last), then of least text hash.

    ``each`` has ``doc_id, h, fp`` for every row (``h`` hashes the text), ``links``
    has ``a, b`` between fingerprints. Ids may be null or repeat: a row is known by
    its id and its text, so no row goes that is not in the component of one that stays.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    firsts = each.groupBy("fp").agg(F.min(order).alias("first"))
    roots = components(links).select(F.col("node").alias("fp"), "root")
    least = firsts.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("part")).agg(F.min("first").alias("first"))
    # ids as text, null as the empty text: the join and the window then share one shuffle of the rows
    kept = least.select(F.coalesce(F.col("first.doc_id").cast("string"), F.lit("")).alias("name"), F.col("first.h").alias("h")).distinct()
    packed = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name"), F.xxhash64("text").alias("h"))
    one = F.row_number().over(Window.partitionBy("name", "h").orderBy("h"))
    return packed.join(kept, ["name", "h"], "left_semi").withColumn("n", one).filter("n = 1").select("row.*")


def keep_one(docs: DataFrame, radius: int = 3, width: int = 3) -> DataFrame:
    """One row of each component, as ``survivors`` chooses it."""
    known = docs.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("doc_id"), "text")
    each = written(fingerprints(known, width).select("doc_id.doc_id", "doc_id.h", "fp"))
    return survivors(docs, each, hamming_links(each.select("fp").distinct(), radius))


def op4_simhash_dedup(spark, sf_dir) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")
