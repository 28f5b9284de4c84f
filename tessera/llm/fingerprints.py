"""SimHash fingerprints in DataFrame functions only, and search by permuted block tables.

A text is lower-cased and cut at ASCII white space into terms. Each occurrence
of a term votes on the 64 bits of its XXH64 with weight ``min(length, 8)``
squared, so longer, more telling terms weigh more; a bit is set when more than
half of the weight wants it. Votes are counted two bits to a long integer (32
sums), exact up to 2^31 of weight in one text (33 million of the longest terms).

Null and blank texts have fingerprint zero. Rows are put in order of id (nulls
first), then text; repeated rows stay apart. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, bucket_of, numbers, table
from tessera.llm.gray_index import tables
from tessera.operators.storage import written

#: Two counters of 32 bits in a long.
PAIR = (1 << 32) | 1
LEAST = -(1 << 63)
#: Rows of an order bucket, and most buckets.
BUCKET_ROWS, MOST_BUCKETS = 500, 1 << 16
#: Fingerprints that may share the leading bits of a table before these are split.
CROWD = 1 << 12


def terms(text: Column) -> Column:
    return F.split(F.lower(text), SPACES)


def vote_sums(term: Column) -> list[Column]:
    h, size = F.xxhash64(term), F.least(F.length(term), F.lit(8))
    weight = (size * size).cast("long")
    lanes = [F.sum(F.shiftrightunsigned(h, i).bitwiseAND(F.lit(PAIR)) * weight).alias(f"v{i}") for i in range(32)]
    return [*lanes, F.sum(weight).alias("weight")]


def majority() -> Column:
    """The fingerprint from the columns of :func:`vote_sums`."""
    out = F.lit(0).cast("long")
    for i in range(32):
        for bit, votes in ((i, F.col(f"v{i}").bitwiseAND(F.lit(0xFFFFFFFF))), (i + 32, F.shiftrightunsigned(f"v{i}", 32))):
            value = (1 << bit) - (1 << 64) * (bit == 63)
            out = out.bitwiseOR(F.when(2 * votes > F.col("weight"), F.lit(value)).otherwise(F.lit(0).cast("long")))
    return out


def simhash(df: DataFrame, keys: list[str], term: str = "term") -> DataFrame:
    """``keys, fp`` from one row per term occurrence."""
    return df.groupBy(*keys).agg(*vote_sums(F.col(term))).select(*keys, majority().alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    return 1.0 - F.bit_count(a.bitwiseXOR(b)) / 64.0


def permuted(fp: Column, order: list[tuple[int, int]]) -> Column:
    """``fp`` with its blocks (lowest bit, width) in this order, the first one leading."""
    out, left = F.lit(0).cast("long"), 64
    for low, width in order:
        left -= width
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1)), left))
    return out


def front_keys(fp: Column, radius: int, spare: int = 2) -> list[Column]:
    """The leading bits of ``fp`` in each permuted table; fingerprints within the radius agree in at least one."""
    return [F.shiftrightunsigned(permuted(fp, order), 64 - front) for order, front in tables(radius, spare)]


def _inner(rest: Column, bits: int, radius: int) -> list[Column]:
    """Keys of the lowest ``bits`` bits: of codes that differ in at most ``radius`` of them at least one key is equal."""
    n = radius + 2
    edges = [bits * i // n for i in range(n + 1)]
    part = [F.shiftright(rest, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(edges, edges[1:])]
    return [F.shiftleft(a, edges[j + 1] - edges[j]).bitwiseOR(part[j]) for i, a in enumerate(part) for j in range(i + 1, n)]


def within_radius(queries: DataFrame, corpus: DataFrame, radius: int = 3) -> DataFrame:
    """``query_fp, fp, distance``: for each distinct ``fp`` of ``queries`` all distinct ``fp`` of ``corpus`` within the radius, itself included.

    Both sides enter one table per block choice and meet on table and leading
    bits; a pair is kept in the first table that it meets in. Larger tables
    take more blocks and so more leading bits. Leading bits that more than
    CROWD fingerprints share are split: there the other bits are cut into
    blocks in the same way, and rows meet on a choice of these too. Nulls match
    nothing.
    """
    known = written(corpus.select("fp").filter("fp IS NOT NULL").distinct())
    count, spare = known.count(), 2
    while spare < 5 and count >> min(front for _, front in tables(radius, spare)) > 4:
        spare += 1
    plan = tables(radius, spare)

    def placed(df: DataFrame) -> DataFrame:
        rows = F.array(*(F.struct(F.lit(t).alias("t"), permuted(F.col("fp"), order).alias("code")) for t, (order, _) in enumerate(plan)))
        front = F.element_at(numbers([64 - f for _, f in plan], "int"), F.col("t") + 1)
        coded = df.select("fp", F.explode(rows).alias("at")).select("fp", "at.t", "at.code", front.alias("wide"))
        return coded.selectExpr("fp", "t", "shiftrightunsigned(code, wide) AS key", "code & (shiftleft(1L, wide) - 1) AS rest")

    own = placed(known)
    crowded = written(own.groupBy("t", "key").count().filter(F.col("count") > CROWD).select("t", "key", F.lit(True).alias("crowded")))
    bits = 64 - min(front for _, front in plan)

    def split(rows: DataFrame) -> DataFrame:
        subs = F.array(*(F.struct(F.lit(s).alias("s"), key.alias("sub")) for s, key in enumerate(_inner(F.col("rest"), bits, radius))))
        plain = F.array(F.struct(F.lit(-1).alias("s"), F.lit(0).cast("long").alias("sub")))
        return rows.join(crowded, ["t", "key"], "left").select("fp", "t", "key", "rest", F.explode(F.when(F.col("crowded"), subs).otherwise(plain)).alias("x")).select("fp", "t", "key", "rest", "x.s", "x.sub")

    right = split(own)
    asked = queries.select("fp").filter("fp IS NOT NULL").distinct()
    left = split(placed(asked)).withColumnsRenamed({"fp": "query_fp", "rest": "query_rest"})
    met = left.join(right, ["t", "key", "s", "sub"])
    distance = F.bit_count(F.col("query_rest").bitwiseXOR(F.col("rest")))

    def first(pairs: list[tuple[Column, Column]]) -> Column:
        return F.coalesce(*(F.when(a == b, F.lit(i)) for i, (a, b) in enumerate(pairs)))

    table_ = first(list(zip(front_keys(F.col("query_fp"), radius, spare), front_keys(F.col("fp"), radius, spare))))
    sub = first(list(zip(_inner(F.col("query_rest"), bits, radius), _inner(F.col("rest"), bits, radius))))
    kept = (distance <= radius) & (F.col("t") == table_) & ((F.col("s") < 0) | (F.col("s") == sub))
    return met.filter(distance <= radius).filter(kept).select("query_fp", "fp", distance.alias("distance"))


def share_a_table(a: Column, b: Column, radius: int) -> Column:
    """Whether ``a`` finds ``b`` in the permuted block tables."""
    met = F.lit(False)
    for x, y in zip(front_keys(a, radius), front_keys(b, radius)):
        met = met | (x == y)
    return met & (F.bit_count(a.bitwiseXOR(b)) <= radius)


def in_order(docs: DataFrame) -> DataFrame:
    """``id, bucket, after, text``: documents in buckets of consecutive ids; the first row of each bucket is also put, with ``after`` = 1, behind the bucket before it (behind the last: the very first).

    The driver gets the bounds of the buckets and the least id in each, at most
    MOST_BUCKETS numbers.
    """
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("place"), F.coalesce("text", F.lit("")).alias("text"))
    count = rows.count()
    n = max(1, min(MOST_BUCKETS, count // BUCKET_ROWS))
    bounds: list[int] = []
    if n > 1:
        bounds = sorted(set(rows.agg(F.percentile_approx("place", [i / n for i in range(1, n)], 10 * n)).first()[0]))
    rows = rows.withColumn("bucket", bucket_of(F.col("place"), bounds).cast("int"))
    least = {r.bucket: r.least for r in rows.groupBy("bucket").agg(F.min("place").alias("least")).collect()}
    if not least:
        return rows.select("id", "place", "bucket", F.lit(0).alias("after"), "text")
    full = sorted(least)
    before = {b: full[i - 1] for i, b in enumerate(full)}
    top = full[-1] + 1
    first = F.col("place") == F.element_at(numbers([least.get(b, 0) for b in range(top)]), F.col("bucket") + 1)
    earlier = F.element_at(numbers([before.get(b, 0) for b in range(top)]), F.col("bucket") + 1).cast("int")
    own = F.struct(F.col("bucket"), F.lit(0).alias("after"))
    behind = F.struct(earlier.alias("bucket"), F.lit(1).alias("after"))
    spread = rows.select("id", "place", "text", F.explode(F.when(first, F.array(own, behind)).otherwise(F.array(own))).alias("at"))
    return spread.select("id", "place", "at.bucket", "at.after", "text")


def edited_fingerprints(docs: DataFrame, radius: int = 3) -> DataFrame:
    """For every document its fingerprint and that of its edited text (its last quarter replaced by the start of the next document)."""
    window = Window.partitionBy("bucket").orderBy("after", "place", "text")
    n, quarter = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.left("text", n - quarter), F.left("next", quarter))
    ordered = in_order(docs).select("*", F.row_number().over(window).alias("n"), F.lead("text").over(window).alias("next"))
    digest = F.sha2("edited", 256)
    part = [F.conv(F.substring(digest, 16 * i + 1, 16), 16, -10).cast("long").alias(f"d{i}") for i in range(4)]
    each = ordered.select("id", "bucket", "after", "n", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    each = each.select("id", "bucket", "after", "n", "n_chars", *part, terms(F.col("text")).alias("own"), F.when(F.col("after") == 0, terms(F.col("edited"))).otherwise(F.array().cast("array<string>")).alias("other"))
    keys = ["id", "bucket", "after", "n", "n_chars", "d0", "d1", "d2", "d3"]
    voted = each.select(*keys, F.size("own").alias("size"), F.posexplode(F.concat("own", "other")).alias("pos", "term"))
    voted = voted.select(*keys, (F.col("pos") >= F.col("size")).alias("is_edited"), "term")
    fps = simhash(voted, [*keys, "is_edited"])
    both = fps.groupBy(*keys).agg(F.max(F.when(~F.col("is_edited"), F.col("fp"))).alias("fp"), F.max(F.when(F.col("is_edited"), F.col("fp"))).alias("edited_fp"))
    follow = F.lead("fp").over(Window.partitionBy("bucket").orderBy("after", "n"))
    out = both.withColumn("next_fp", follow).filter("after = 0")
    sha = F.concat(*(F.lpad(F.lower(F.hex(f"d{i}")), 16, "0") for i in range(4)))
    return out.select(F.col("id").alias("doc_id"), "n_chars", sha.alias("edited_sha256"), "fp", "edited_fp", "next_fp", share_a_table(F.col("fp"), F.col("edited_fp"), radius).alias("edited_in_radius"))


def with_neighbours(found: DataFrame, radius: int = 3) -> DataFrame:
    """``found`` (``doc_id, fp, ...``) with ``n_near``, the number of other different fingerprints in it within the radius, and ``first_near``, the least id of a document that has one of them (null if there is none)."""
    found = written(found)
    least = found.groupBy("fp").agg(F.min("doc_id").alias("first"))
    pairs = within_radius(found, found, radius).filter("distance > 0")
    near = pairs.join(least, "fp").groupBy("query_fp").agg(F.count(F.lit(1)).alias("n_near"), F.min("first").alias("first_near"))
    near = written(near)  # so that both sides of the join are plain exchanges, and the partition of a very common text can be split
    return found.join(near, F.col("fp") == F.col("query_fp"), "left").drop("query_fp").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long")))


def op3_fingerprint(spark, sf_dir) -> DataFrame:
    found = with_neighbours(edited_fingerprints(table(spark, sf_dir, "documents")))

    def text(c: str) -> Column:
        return F.lpad(F.lower(F.hex(c)), 16, "0")

    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        text("fp").alias("fingerprint"),
        text("edited_fp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        "edited_in_radius",
        "n_near",
        "first_near",
    )
