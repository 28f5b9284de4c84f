"""Near duplicates, lines, mixing, packing, language model, top-k and the pipeline against plain versions."""

from __future__ import annotations

import math
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import brown_lm, common, gray_index, line_dedup, mixing, packing, shingle_dedup, simhash_dedup, tokens, topk
from tessera.llm.components import components
from tessera.llm.langid import part

MANY = settings(max_examples=100, deadline=None)
WORD = r"[^\x20\x09-\x0D]+"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def union_find(n, links):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def plain_simhash(text):
    words = re.findall(WORD, low(text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), seed=42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates(docs, doc_rows, none):
    got = simhash_dedup.near_duplicates(docs).collect()
    fps = [plain_simhash(t) for _, t, *_ in doc_rows]
    parts = union_find(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    least = {}
    for p, (d, *_) in zip(parts, doc_rows):
        least[p] = min((x for x in (least.get(p), d) if x is not None), default=None)
    want = Counter((d, f, least[p]) for (d, *_), f, p in zip(doc_rows, fps, parts))
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want
    assert simhash_dedup.near_duplicates(none).count() == 0
    kept = simhash_dedup.keep_one(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and len(ids) == len(set(ids)) and set(ids) == set(least.values())
    assert simhash_dedup.keep_one(none).count() == 0


def test_one_row_of_each_component_stays(spark):
    rng = random.Random(11)
    texts = [" ".join(str(rng.randrange(10**6)) for _ in range(60)) for _ in range(8)]
    rows = [(None, t) for t in texts[:5]]  # different texts without an id
    rows += [(1, texts[5]), (2, texts[5]), (2, texts[6]), (3, texts[7]), (3, texts[7]), (None, texts[7])]  # id 2 repeats with another text
    kept = simhash_dedup.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    want = [(None, t) for t in texts[:5]] + [(1, texts[5]), (2, texts[6]), (3, texts[7])]
    assert Counter((r.doc_id, r.text) for r in kept) == Counter(want)


def plain_shingles(text):
    words = re.findall(WORD, low(text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_pipeline_drops_similar_texts(spark, docs, doc_rows, none):
    rng = random.Random(12)
    rows = list(doc_rows)
    for i in range(60):  # a few changed words: far apart as SimHash of short texts
        words = [str(rng.randrange(10**5)) for _ in range(rng.choice([8, 40, 90, 300]))]
        for j in range(3):
            rows.append((1000 + 3 * i + j if i % 7 else None, " ".join(words), "en", "s1", 1))
            for _ in range(rng.randrange(1, 3)):
                words[rng.randrange(len(words))] = rng.choice(["x", "Y", "zz"])
    sets = [plain_shingles(r[1]) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    parts = union_find(len(rows), links)
    assert any(plain_simhash(rows[i][1]) ^ plain_simhash(rows[j][1]) and (plain_simhash(rows[i][1]) ^ plain_simhash(rows[j][1])).bit_count() > 3 for i, j in links)
    key = docs.columns[:5]
    kept = corpus_pipeline.STAGES[2][1](spark, spark.createDataFrame(rows, docs.select(*key).schema), "").collect()
    by_row = {}
    for r, p in zip(rows, parts):
        by_row[r[0], r[1]] = p
    got = Counter(by_row[r.doc_id, r.text] for r in kept)
    assert got == Counter(set(parts))
    least = {}
    for r, p in zip(rows, parts):
        least[p] = min((x for x in (least.get(p), r[0]) if x is not None), default=None)
    assert all(least[by_row[r.doc_id, r.text]] == r.doc_id for r in kept)
    assert shingle_dedup.keep_one_similar(none).count() == 0


def test_pipeline_links_by_simhash(spark):
    rng = random.Random(18)
    rows = []
    for i in range(12):
        words = [str(rng.randrange(10**5)) for _ in range(900)]
        rows.append((2 * i, " ".join(words)))
        words[rng.randrange(900)] = "x"
        rows.append((2 * i + 1, " ".join(words)))
    sims = [shingle_dedup.majority(shingle_dedup.shingles(t)) for _, t in rows]
    linked = {(i, j) for i in range(len(rows)) for j in range(i) if ((sims[i] ^ sims[j]) & ((1 << 64) - 1)).bit_count() <= 3}
    assert len(linked) > 6 and all(i - j == 1 and j % 2 == 0 for i, j in linked) and any(sims[i] != sims[j] for i, j in linked)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    known = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    each = common.map_arrow(known, lambda b: shingle_dedup._signed(b, 5), "doc_id bigint, h bigint, fp bigint, sim bigint, keys array<bigint>")
    # without a MinHash key sets meet by their fingerprints only
    each = each.withColumn("keys", F.array().cast("array<bigint>")).localCheckpoint()
    by_fp = {r.fp: r.doc_id for r in each.collect()}
    links = shingle_dedup.similar_links(docs, each, 5, 0.8).collect()
    assert {tuple(sorted((by_fp[r.a], by_fp[r.b]), reverse=True)) for r in links} == linked


def test_link_sets_joins_what_chains_join():
    rng = np.random.default_rng(3)
    for _ in range(60):
        base = [np.unique(rng.integers(0, 60, 30)) for _ in range(4)]
        sets = [np.unique(np.append(rng.permutation(b)[2:], rng.integers(0, 60, rng.integers(3)))).astype(np.uint64) for b in base for _ in range(10)]
        pairs = [(i, j) for i in range(40) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
        assert shingle_dedup.link_sets(sets, 0.8).tolist() == union_find(40, pairs)


@MANY
@given(st.lists(st.integers(0, (1 << 64) - 1), min_size=1, max_size=20), st.integers(0, 4), st.integers(0, 1 << 30))
def test_link_group_joins_what_chains_join(base, radius, seed):
    rng = random.Random(seed)
    codes = set(base)
    for _ in range(120):  # chains of near codes
        c = rng.choice(sorted(codes))
        for _ in range(rng.randrange(6)):
            c ^= 1 << rng.randrange(64)
        codes.add(c)
    ranked = np.array(sorted(codes), np.uint64)
    ranked = ranked[np.argsort(gray_index.gray_rank(ranked))]
    plain = union_find(len(ranked), [(i, j) for i in range(len(ranked)) for j in range(i) if int(ranked[i] ^ ranked[j]).bit_count() <= radius])
    assert gray_index.link_group(ranked, radius).tolist() == plain


def test_tables_meet_every_pair_within_the_radius():
    rng = random.Random(1)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for _ in range(3):
            b ^= 1 << rng.randrange(64)
        x = np.array([a, b], np.uint64)
        assert any(len(set((gray_index.permuted(x, order) >> np.uint64(64 - front)).tolist())) == 1 for order, front in gray_index.tables(3))
        g = gray_index.gray_rank(x)
        assert ((g ^ (g >> np.uint64(1))) == x).all()


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(500, x) for x in range(501, 560)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    plain = union_find(600, edges)
    assert all(got.get(i, i) == plain[i] for i in range(600))
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=500, deadline=None)
@given(st.text("ab", max_size=14), st.lists(st.tuples(st.integers(0, 14), st.sampled_from("abc-")), max_size=4), st.integers(0, 3))
def test_edit_distance_and_windows(a, edits, k):
    b = a
    for at, c in edits:
        b = b[:at] + b[at + 1 :] if c == "-" else b[:at] + c + b[at + (at % 2) :]
    d = levenshtein(a, b)
    assert line_dedup.edit_distance_within(a, b, k) == (d if d <= k else None)
    assert line_dedup.within_many(a, [b, a, b + "xy", b[1:]], k).tolist() == [levenshtein(a, x) <= k for x in (b, a, b + "xy", b[1:])]
    if d <= k:
        assert (line_dedup.signature(a) ^ line_dedup.signature(b)).bit_count() <= 2 * k
        long, short = (a, b) if len(a) >= len(b) else (b, a)
        if len(short) > k:
            cut = [short[p : p + n] for p, n in line_dedup.segments(len(short), k)]
            assert any(long[p : p + n] == cut[i] for i, n, first, last in line_dedup.windows(len(long), len(short), k) for p in range(first, last + 1))


def test_line_dedup(spark, docs, doc_rows, none):
    rng = random.Random(8)
    rows = [(d, t) for d, t, *_ in doc_rows if d is not None]
    lines = sorted({x for _, t in rows for x in (t or "").split("\n") if len(x) >= 40})
    for i in range(60):  # near copies of lines, in documents of their own
        x = list(rng.choice(lines))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(x))
            x[at : at + rng.randrange(2)] = rng.choice(["", "q", "zz"])
        rows.append((1000 + i, "short\n" + "".join(x) + "\n" + rng.choice(lines)))
    rows.append((5000, "\n".join(lines[:5])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.row.doc_id, r.row.text): (r.clean, r.removed) for r in line_dedup.without_repeats(df).collect()}
    order = sorted(set(rows), key=lambda r: r[0])
    first = {}
    for d, t in order:
        for i, x in enumerate((t or "").split("\n")):
            if len(x) >= line_dedup.EXACT_LENGTH:
                first.setdefault(x, (d, i))
    long = [x for x in first if len(x) >= line_dedup.MIN_LENGTH]
    near = {x for x in long if any(first[y] < first[x] and abs(len(x) - len(y)) <= 2 and len(x) < 2000 and levenshtein(x, y) <= 2 for y in long)}
    assert near
    for d, t in order:
        kept = [x for i, x in enumerate((t or "").split("\n")) if len(x) < line_dedup.EXACT_LENGTH or (first[x] == (d, i) and x not in near)]
        assert got[d, t] == (t if t is None else "\n".join(kept), len((t or "").split("\n")) - len(kept))
    done = line_dedup.deduplicated(docs)
    assert done.columns == docs.columns and 0 < done.count() < docs.count()
    assert line_dedup.deduplicated(none).count() == 0


def test_links_in_large_groups():
    rng = random.Random(14)
    made = {"dense": lambda: f"the same old passage {rng.randrange(3000)} and its end", "sparse": lambda: f"the same old passage {rng.randrange(10**7):07d} and its end", "two": lambda: rng.choice(("", "before ")) + f"passage {rng.randrange(40)} of {rng.randrange(10**5)}"}
    for name, make in made.items():
        lines = list(dict.fromkeys(make() for _ in range(400)))
        linked = np.zeros(len(lines), bool)
        line_dedup.mark_links(lines, 2, linked, np.arange(len(lines)))
        want = [any(abs(len(x) - len(y)) <= 2 and levenshtein(x, y) <= 2 for y in lines[:i]) for i, x in enumerate(lines)]
        assert linked.tolist() == want and any(want), name


def test_common_passages_take_linear_time():
    rng = random.Random(15)
    took = []
    for n in (2_000, 8_000):
        lines = list(dict.fromkeys(f"a passage that everybody copies, number {rng.randrange(10**12):012d}, and so on" for _ in range(n)))
        linked = np.zeros(len(lines), bool)
        began = time.time()
        line_dedup.mark_links(lines, 2, linked, np.arange(len(lines)))
        took.append(time.time() - began)
    assert took[1] < 6 * took[0] + 0.5, took


def test_near_copies_that_do_not_link_take_little_time():
    rng = random.Random(16)
    base = "".join(rng.choice("abcdefghij klmnop") for _ in range(400))

    def copy():
        out = list(base)
        for _ in range(rng.randint(1, 4)):
            out[rng.randrange(len(out))] = rng.choice("abcdefghij klmnop")
        return "".join(out)

    lines = list(dict.fromkeys(copy() for _ in range(240)))
    linked = np.zeros(len(lines), bool)
    began = time.time()
    line_dedup.mark_links(lines, 2, linked, np.arange(len(lines)))
    assert time.time() - began < 20
    want = [any(line_dedup.edit_distance_within(x, y, 2) is not None for y in lines[:i]) for i, x in enumerate(lines[:80])]
    assert linked[:80].tolist() == want and any(want) and not all(want[1:])


def test_lines_of_one_document_take_linear_time(spark):
    def seconds(n):
        text = "\n".join(f"a line of many words that comes again {i % 7}" for i in range(n))
        df = spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string")
        began = time.time()
        rows = {r.row.doc_id: r for r in line_dedup.without_repeats(df).collect()}
        assert rows[1].removed == n - 1 and rows[1].clean == text.split("\n")[0] and rows[2].clean is None
        return time.time() - began

    seconds(1_000)
    short, long = seconds(20_000), seconds(80_000)
    assert long < 4 * short + 1, (short, long)


def test_mixing(docs, doc_rows, none):
    frame = pd.DataFrame(doc_rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64"})
    connection = duckdb.connect()
    connection.register("documents", frame)
    want = Counter(tuple(None if x is pd.NA else x for x in r) for r in connection.execute(mixing.OP8_SQL).fetchall())
    found = mixing.mix(docs)
    got = Counter((r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in found.collect())
    assert got == want
    taken = mixing.mixed_documents(docs)
    assert taken.columns == docs.columns
    assert taken.count() == found.agg(F.sum("copies")).first()[0]
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0


@MANY
@given(st.dictionaries(st.one_of(st.none(), st.text(max_size=2)), st.integers(0, 1000), min_size=1, max_size=8))
def test_targets(sizes):
    targets = mixing.water_fill(sizes)
    total = 1.5 * sum(sizes.values())
    assert math.isclose(sum(targets.values()), total, abs_tol=1e-6)
    assert all(t <= 2 * sizes[s] + 1e-9 for s, t in targets.items())


def test_packing(docs, doc_rows, none, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "SHARD_DOCS", 40)
    path = packing.default_tokenizer()
    plain = Tokenizer.from_file(path)
    pieces = packing.packed(docs, path).toPandas()
    ids = Counter()
    for d, t, *_ in doc_rows:
        ids[d, tuple([*plain.encode(t or "", add_special_tokens=False).ids, 1])] += 1
    sequences = pieces.sort_values("offset").groupby("sequence_id")
    for _, g in sequences:
        total = g["length"].sum()
        assert g["offset"].tolist() == (g["length"].cumsum() - g["length"]).tolist()
        assert total == 2048 or total & (total - 1) == 0
    # every id of every document lies in as many pieces as the document has rows
    for (d, want), n in ids.items():
        own = pieces[(pieces.doc_id.isna() if d is None else pieces.doc_id == d) & (pieces.doc_tokens == len(want))]
        covered = Counter()
        for r in own.itertuples():
            if zlib.crc32(np.array(want[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32:
                covered.update(range(r.start, r.start + r.length))
        assert all(covered[i] >= n for i in range(len(want)))
    assert pieces["length"].sum() == sum(len(i) * n for (_, i), n in ids.items())
    assert packing.packed(none, path).count() == 0
    again = packing.packed(docs, path).toPandas()
    key = list(pieces.columns)
    assert pieces.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))


def test_neighbours_meet_in_one_shard(spark, monkeypatch):
    rng = random.Random(13)
    monkeypatch.setattr(packing, "SHARD_DOCS", 50)
    topics = [[f"{w}{k}" for w in ("apple", "river", "stone", "music", "paper", "light", "horse", "cloud")] for k in rng.sample(range(1000, 9999), 8)]
    rows = [(i, " ".join(rng.choice(topics[i % 8]) for _ in range(30))) for i in range(800)]
    pieces = packing.packed(spark.createDataFrame(rows, "doc_id bigint, text string"), packing.default_tokenizer()).toPandas()
    shards = pieces.assign(shard=pieces.sequence_id // (1 << 32), topic=pieces.doc_id % 8).drop_duplicates(["doc_id"])
    assert shards.groupby("shard").size().tolist() == [50] * 16
    # of a shard's documents most share one topic; dealt at random it would be about a quarter
    assert shards.groupby("shard").topic.agg(lambda t: t.value_counts().iloc[0] / len(t)).mean() > 0.6


def test_words_are_cut_where_the_tokenizer_cuts():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    plain, ours = Tokenizer.from_file(path), packing.tokenizer(path)
    odd = [*range(0x20), *range(0x7F, 0xA1), 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]
    for c in map(chr, odd):
        for text in (f"ab{c}cd", f"{c}ab {c} cd{c}", f"ab{c}\x1c\u2003{c}cd"):
            assert ours.ids(text).tolist() == plain.encode(text, add_special_tokens=False).ids, ascii(text)
    every = [t for c in range(0x10000) if not 0xD800 <= c < 0xE000 for t in (chr(c), f"Ab{chr(c)}cD")]
    ids, start = ours.of(pa.array(every))
    for text, a, b in zip(every, start, start[1:]):
        assert ids[a:b].tolist() == plain.encode(text, add_special_tokens=False).ids, ascii(text)


def test_ranking_is_bm25():
    rng = np.random.default_rng(5)
    docs = [np.append(rng.zipf(1.3, rng.integers(1, 80)) % 400, 1).astype("<u4") for _ in range(120)]
    docs += [docs[0], docs[1][:1]]
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(t for d in docs for t in set(d.tolist()))
    index = packing.Index(docs)
    assert len(index.dense) and (index.df > 0).any()
    for seed in (0, 7, 121):
        want = []
        for d in docs:
            tf = Counter(d.tolist())
            want.append(sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in set(docs[seed].tolist()) if t in tf))
        assert np.allclose(index.scores(seed), want, rtol=1e-5)
        near = list(index.nearest(seed, np.ones(n, bool)))
        assert sorted(near) == list(range(n)) and all(want[a] >= want[b] - 1e-4 for a, b in zip(near, near[1:]))


def test_neighbours_share_terms():
    rng = np.random.default_rng(0)
    topics = [rng.choice(40_000, 60) for _ in range(5)]
    docs = [rng.choice(topics[i % 5], 50).astype("<u4") for i in range(50)]
    index = packing.Index(docs)
    unused = np.ones(50, bool)
    unused[0] = False
    assert [n % 5 for n in list(index.nearest(0, unused))[:9]] == [0] * 9
    assert sum(p[2] for s in packing.pack(docs, 64) for p in s) == 2500


def test_class_language_model(docs, doc_rows, none, monkeypatch):
    monkeypatch.setattr(brown_lm, "CLASSED", 300)
    monkeypatch.setattr(brown_lm, "CORE", 50)
    held = F.coalesce(part(F.col("doc_id"), 10) == 0, F.lit(False))
    rows = docs.withColumn("held_out", held)
    got = brown_lm.score_documents(rows, rows.filter("NOT held_out")).collect()
    known = [d is None or zlib.crc32(str(d).encode()) % 10 != 0 for d, *_ in doc_rows]
    words = [re.findall(WORD, low(t)) for _, t, *_ in doc_rows]
    counts, ends = Counter(w for ws, k in zip(words, known) if k for w in ws), sum(known)
    n, v = sum(counts.values()) + ends, len(counts) + 1
    base = lambda c: math.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    want = sorted((str(d), not k, len(ws) + 1, sum(w in counts for w in ws) + 1, round(sum(base(counts[w]) for w in ws) + base(ends), 5)) for (d, *_), k, ws in zip(doc_rows, known, words))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 for r in got)
    assert brown_lm.score_documents(rows.filter("false"), rows.filter("NOT held_out")).count() == 0
    assert brown_lm.score_documents(rows, rows.filter("false")).count() == len(doc_rows)


def test_class_model_is_a_distribution(spark):
    texts = ["a b a c", "b a", "c c a b d", ""] * 5
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    model, counts = brown_lm.train(docs)
    assert np.allclose((10**model.transition).sum(axis=1), 1)
    by_class = {}
    c = {r.h: r.c for r in counts.collect()}
    words = brown_lm.Words()
    words.ids([[w.encode() for w in "abcd"]])
    for h, k in zip(words.h.tolist(), model.label[model.units.of(words.h, words.ending)]):
        by_class[k] = by_class.get(k, 0) + (c[h] + 0.1) / 10 ** model.emission[k]
    unknown = {k: 0.1 / 10 ** model.emission[k] for k in by_class}
    assert all(abs(by_class[k] + unknown[k] - 1) < 1e-9 for k in by_class)


def test_scores_and_classes_by_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(brown_lm, "CORE", 12)
    monkeypatch.setattr(brown_lm, "CLASSES", 6)
    monkeypatch.setattr(brown_lm, "CLASSED", 60)
    rng = random.Random(16)
    words = [f"{c}{i}" for c in "abcde" for i in range(20)]
    texts = [" ".join(words[(rng.randrange(20) if rng.random() < 0.3 else min(19, int(rng.expovariate(0.4)))) + 20 * ((j + i) % 5)] for j in range(rng.randrange(12))) for i in range(150)]
    docs = spark.createDataFrame([(i, t, i % 5 == 0) for i, t in enumerate(texts)], "doc_id int, text string, held_out boolean").repartition(3)
    training = docs.filter("NOT held_out")
    model, counts = brown_lm.train(training)
    table = brown_lm.Words()
    table.ids([[w.encode() for w in words]])
    first = dict(zip(words, model.label[model.units.of(table.h, table.ending)].tolist()))
    final = dict(zip(words, model.classes(table.h, table.ending).tolist()))
    seen = [t.split() for i, t in enumerate(texts) if i % 5]
    c, end, k = Counter(w for t in seen for w in t), int(model.label[model.units.end]), len(model.emission)
    assert {r.h: r.c for r in counts.collect()} == {h: c[w] for h, w in zip(table.h.tolist(), words) if c[w]}

    def joint(of):
        out = np.zeros((k, k))
        for t in seen:
            row = [end, *(of[w] for w in t), end]
            for a, b in zip(row, row[1:]):
                out[a, b] += 1
        return out

    before = joint(first)
    core = set(model.units.core.tolist())
    chosen = 0
    for w, h in zip(words, table.h.tolist()):
        if h in core or c[w] < brown_lm.OWN or h not in set(model.head.tolist()):
            assert final[w] == first[w]
            continue
        gain = np.full(k, 0.0)
        for t in seen:
            row = [end, *(first[x] for x in t), end]
            for i, x in enumerate(t, 1):
                if x == w:
                    to = np.log((before + 0.1) / (before.sum(1, keepdims=True) + 0.1 * k))
                    gain += to[row[i - 1]] + to[:, row[i + 1]] - np.log(before.sum(0) + 0.1)
        gain[0] = -np.inf
        assert gain[final[w]] > gain.max() - 1e-6
        chosen += 1
    assert chosen > 10
    after = joint(final)
    share = (after.sum(0) + 0.1) / (after.sum() + 0.1 * k)
    assert np.allclose(10**model.transition, (after + 5 * share) / (after.sum(1, keepdims=True) + 5))
    size = [sum(c[w] for w in words if final[w] == x) + 0.1 * (sum(c[w] > 0 for w in words if final[w] == x) + 1) for x in range(k)]
    assert np.allclose(10**model.emission, size)
    got = {r.doc_id: r.score for r in brown_lm.score_documents(docs, training).collect()}
    for i, t in enumerate(texts):
        row = [end, *(final[w] for w in t.split()), end]
        want = sum(model.transition[a, b] for a, b in zip(row, row[1:])) + sum(math.log10((c[w] + 0.1) / size[final[w]]) for w in t.split())
        assert math.isclose(got[i], want, abs_tol=1e-6), i


def test_equally_frequent_words_are_classed(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{2 * j + x} v{2 * j + 1 - x}" for j in range(i % 5, 750, 5) for x in (0, 1))) for i in range(25)], "doc_id int, text string")
    model, _ = brown_lm.train(docs)
    assert len(model.units.core) == brown_lm.CORE and len(model.head) == 3000
    monkey = brown_lm._frequent(spark.createDataFrame([(i, 5) for i in range(4000)], "h bigint, c bigint"), {5: 4000}, 1000).count()
    assert 800 < monkey <= 1100


def test_core_is_full_where_words_tie(spark, monkeypatch):
    monkeypatch.setattr(brown_lm, "CORE", 3)
    docs = spark.createDataFrame([(i, "a b c d e f") for i in range(4)], "doc_id int, text string")
    model, _ = brown_lm.train(docs)
    assert len(model.units.core) == 3
    # no token is counted twice or lost: the six words and the unseen one of each class sum to one
    words = brown_lm.Words()
    words.ids([[w.encode() for w in "abcdef"]])
    by_class = {}
    for k in model.label[model.units.of(words.h, words.ending)]:
        by_class[k] = by_class.get(k, 0) + 4.1 / 10 ** model.emission[k]
    assert all(abs(x + 0.1 / 10 ** model.emission[k] - 1) < 1e-9 for k, x in by_class.items())


def test_exchange_finds_classes():
    rng = np.random.default_rng(0)
    counts = np.zeros((41, 41))
    now = 0
    for _ in range(20_000):  # even units are followed by odd ones, odd by even
        now, before = rng.integers(20) * 2 + 1 - now % 2, now
        counts[before, now] += 1
    label = brown_lm.exchange(counts, classes=3)
    assert len(set(label[:40:2])) == 1 and len(set(label[1:40:2])) == 1 and label[0] != label[1] and label[40] == 0


def test_exchange_ends_where_no_move_helps():
    """Units around a ring, of which the exchange takes 81 sweeps."""
    n = 381
    counts, i = np.zeros((n + 1, n + 1)), np.arange(n + 1)
    for step, weight in enumerate([16, 17], 1):
        counts[i, (i + step) % (n + 1)] += weight

    def likelihood(label):
        member = np.eye(3)[label]
        joint = member.T @ counts @ member
        return brown_lm._xlogx(joint).sum() - brown_lm._xlogx(joint.sum(0)).sum() - brown_lm._xlogx(joint.sum(1)).sum()

    label = brown_lm.exchange(counts, classes=3)
    assert label[n] == 0 and set(label[:n]) == {1, 2}
    for unit in range(n):
        other = label.copy()
        other[unit] = 3 - label[unit]
        assert likelihood(other) <= likelihood(label) + 1e-6


def test_top_k(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1 + i % 3) for _ in range(12)], i) for i in range(300)]
    rows += [(300 + i, rows[i][1], 0) for i in range(20)]  # ties
    rows += [(400, None, 0), (500, [1.0, None], 0), (600, [1.0, math.nan], 0), (700, [math.inf] * 12, 0), (800, [], 0), (900, [2.0, -1.0], 0), (None, [1.0] * 12, 0), (10, rows[10][1], 0)]
    rows += [(77, [0.5] * 12, 0)] * 200  # one id, one vector, more rows than a block
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, norm int").withColumn("c", F.lit("extra"))
    sound = [(i, [math.floor(1024 * x) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = {}
    for q, a in {i: v for i, v in sound if i % 100 == 0}.items():
        scored = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in sound if i != q))[:10]
        want[q] = [(n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    for block in (64, 1 << 13):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(topk, "BLOCK_ROWS", block)
            patch.setattr(topk, "HEAD", 16)
            got = {}
            for r in topk.top_k(df, F.col("id") % 100 == 0).collect():
                got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        assert {q: sorted(x) for q, x in got.items()} == want
    assert 800 in want
    assert topk.top_k(df.filter("false"), F.col("id") % 100 == 0).count() == 0
    assert topk.top_k(df.filter("vec_id < 5"), F.col("id") % 100 == 0).count() == 4
    assert [r.score for r in topk.top_k(df.filter("vec_id = 800 OR vec_id = 3"), F.col("id") % 100 == 0).collect()] == [0]


def test_top_k_of_large_components(spark):
    def rows(*vectors):
        return spark.createDataFrame([(100 * i, list(v)) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")

    asked = F.col("id") % 100 == 0
    big = 2.0**40
    got = {(r.query_id, r.vec_id): r.score for r in topk.top_k(rows((big, big, 1.0), (big, -big, 2.0)), asked).collect()}
    assert got == {(0, 100): 2 << 20, (100, 0): 2 << 20}  # the two great products cancel
    for bad in (((big, 1.0), (big, 1.0)), ((big, 1.0), (-big, 1.0)), ((2.0**60, 1.0), (1.0, 1.0)), ((3e300, 1.0), (1.0, 1.0))):
        with pytest.raises(Exception, match="beyond 64 bits"):
            topk.top_k(rows(*bad), asked).collect()


def test_block_pairs_out_of_reach_are_not_made(spark):
    levels = [(0, 2, 9.0), (2, 0, 0.0), (2, 1, 5.0), (3, 3, 1.0)]
    blocks = spark.createDataFrame([(0, 0.0), (1, 4.9), (2, 5.1), (3, 9.5)], "q bigint, reach double")
    got = sorted((r.q, r.c) for r in topk.pairs_of_blocks(blocks, levels).collect())
    assert got == [(0, c) for c in range(6)] + [(1, c) for c in range(3)] + [(2, 0), (2, 1)]


def plain_line_dedup(rows):
    """The texts of rows (id, text) after exact and near repeats of lines went, and those of which nothing is left."""
    key = lambda r: (r[0] is not None, r[0] or 0, xxhash.xxh64_intdigest(r[1].encode(), seed=42) - (1 << 64) * (xxhash.xxh64_intdigest(r[1].encode(), seed=42) >> 63) if r[1] is not None else 42)
    order = sorted(set(rows), key=key)
    first = {}
    for n, (_, t) in enumerate(order):
        for i, x in enumerate((t or "").split("\n")):
            if len(x) >= line_dedup.EXACT_LENGTH:
                first.setdefault(x, (n, i))
    long = [x for x in first if line_dedup.MIN_LENGTH <= len(x) < 2000]
    near = {x for x in long if any(first[y] < first[x] and abs(len(x) - len(y)) <= 2 and levenshtein(x, y) <= 2 for y in long)}
    out = {}
    for n, (d, t) in enumerate(order):
        lines = (t or "").split("\n")
        kept = [x for i, x in enumerate(lines) if len(x) < line_dedup.EXACT_LENGTH or (first[x] == (n, i) and x not in near)]
        out[d, t] = t if len(kept) == len(lines) else "\n".join(kept)
    return {k: v for k, v in out.items() if v == k[1] or v.strip(" ")}


def plain_near_dedup(rows):
    """The (id, text) of one row of each component of five-word shingles."""
    sets = [plain_shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    return union_find(len(rows), links)


def test_each_stage_of_the_pipeline(spark, docs, doc_rows, tmp_path):
    from tessera.llm import langid

    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    rng = random.Random(17)
    lines = [x for _, t, *_ in doc_rows for x in (t or "").split("\n") if 40 < len(x) < 300]
    more = [(2000 + i, "\n".join(rng.sample(lines, 3) + [f"a line of document {i}, number {rng.random()}"]), "en", "s2", 1) for i in range(20)]
    more += [(None, "a text without an id " * 4, "de", None, 1), (None, "a text without an id " * 4, "de", None, 1)]
    plain.union(spark.createDataFrame(more, plain.schema)).write.parquet(str(tmp_path / "documents.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    pair = lambda r: (r.doc_id, r.text)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = at.collect()
        out = stage(spark, at, str(tmp_path))
        assert out.columns == plain.columns, name
        out.write.parquet(str(tmp_path / name))
        was, at = at, spark.read.parquet(str(tmp_path / name))
        after = at.collect()
        assert after, name
        if name == "language":
            judged = langid.score(was.select(F.struct("*").alias("key"), "text"), langid.train(was), "key").collect()
            assert Counter(map(pair, after)) == Counter(pair(r.key) for r in judged if not r.rejected)
            assert any(r.rejected for r in judged) and all(r.key.text not in (None, "") for r in judged if not r.rejected)
        elif name == "line-dedup":
            want = plain_line_dedup(list(map(pair, before)))
            assert Counter((r.doc_id, r.text) for r in after) == Counter((r.doc_id, want[pair(r)]) for r in before if pair(r) in want)
            assert all(r.n_chars in (len(r.text), None) or pair(r) in map(pair, before) for r in after) and len(after) < len(before)
        elif name == "near-dedup":
            parts = dict(zip(map(pair, before), plain_near_dedup(list(map(pair, before)))))
            assert Counter(parts[pair(r)] for r in after) == Counter(set(parts.values()))
        else:
            copies = {}
            for r in mixing.mix(was).collect():
                copies[r.doc_id, r.source] = r.copies
            triple = lambda r: (r.doc_id, r.source, r.text)
            assert Counter(map(triple, after)) == +Counter({k: n * copies[k[:2]] for k, n in Counter(map(triple, before)).items()})
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter((r.doc_id, len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in at.collect())
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = Counter()
    for r in pieces:
        got[r.doc_id, r.doc_tokens] += r.length
    assert got == Counter({k: n * k[1] for k, n in want.items()})
    assert corpus_pipeline.STAGES[-1][1](spark, plain.filter("false"), "").count() == 0


def test_stages_of_an_empty_table(spark, none):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none.select("doc_id", "text", "lang", "source", "n_chars"), "").count() == 0, name


def test_tasks_give_their_memory_back(spark, monkeypatch):
    def held(batches):
        for batch in batches:
            kept = [bytes(1 << 10) for _ in range(100_000)]  # small pieces, which the allocator keeps
            del kept
            yield batch

    def resident(batches):
        for batch in batches:
            rss = int(next(x for x in open("/proc/self/status") if x.startswith("VmRSS")).split()[1]) >> 10
            yield pa.RecordBatch.from_arrays([pa.array([rss] * batch.num_rows, pa.int64())], names=["id"])

    one = spark.range(1).coalesce(1)
    before = common.map_arrow(one, resident, "id bigint").first().id
    common.map_arrow(one, held, "id bigint").collect()
    assert common.map_arrow(one, resident, "id bigint").first().id < before + 50


def test_routing_forgets_the_tokenizer():
    path = packing.default_tokenizer()
    tokens.tokenizer(path)
    docs = [np.array([2, 3, 1], "<u2"), np.array([3, 4, 1], "<u2")]
    statistics = packing.Statistics(2, 3.0, np.bincount(np.concatenate(docs), minlength=1 << 16))
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([8]), pa.array([docs[0].tobytes()])], names=["doc_id", "h", "ids"])
    shared = type("Shared", (), {"value": (docs, statistics)})
    assert len(list(packing._routed(iter([batch]), "<u2", shared))) == 1
    assert tokens.tokenizer.cache_info().currsize == 0


def test_router_by_plain_weights():
    rng = np.random.default_rng(19)
    docs = [np.append(np.minimum(rng.zipf(1.3, rng.integers(0, 200)), 3000), 1).astype("<u2") for _ in range(600)]
    statistics = packing.Statistics(600, float(np.mean([len(d) for d in docs])), np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=1 << 16))
    router = packing.Router(docs[:512], statistics)
    assert len(router.table) < 512  # rows of terms that few leaders hold would fill a task's memory
    assert len(router.leader) + np.count_nonzero(router.table) == sum(len(np.unique(d)) for d in docs[:512])

    def weights(d):
        out = np.zeros(1 << 16)
        for t, tf in Counter(d.tolist()).items():
            df = statistics.df[t]
            out[t] = math.log(1 + (600 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / statistics.mean))
        return out

    leaders = np.array([w / np.linalg.norm(w) for w in map(weights, docs[:512])])
    for d in docs[500:540]:
        key, own = router.key(d), weights(d)
        near = leaders @ own
        for n, shift in zip(packing.LEVELS, (51, 42, 33, 24)):
            assert near[(key >> shift) & 511] > near[:n].max() - 1e-4
        assert own[key & ((1 << 24) - 1)] > own.max() - 1e-9


def test_remembered_words_do_not_change_ids():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    plain, ours = Tokenizer.from_file(path), packing.tokenizer(path)
    many = " ".join(f"w{i:x}" for i in range(30_000))
    texts = [many, "", " ", "A\x1cB İ, ΣΑΣ", many.upper(), None, "a  b "]
    for _ in range(3):
        ids, at = ours.of(pa.array(texts, pa.string()))
        for text, a, b in zip(texts, at, at[1:]):
            assert ids[a:b].tolist() == plain.encode(text or "", add_special_tokens=False).ids
