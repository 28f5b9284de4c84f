"""Personal data, language, fingerprints and licences against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections import Counter
from itertools import accumulate
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import boosting, fingerprints, langid, licenses, pii

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def luhn(digits):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(digits)))) % 10 == 0


def plain_spans(text):
    def passes(kind, m):
        d = re.sub("[^0-9]", "", m)
        return [True, kind == 1 and all(int(x) <= 255 for x in m.split(".")), 14 <= len(d) <= 19 and luhn(d or "1"), 10 <= len(d) <= 15][kind]

    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text or "") if passes(k, m.group()))


TRICKY = [
    "a@b.c+d@e.f x@y@z.w .@x.y a@b a@b..c 'q_r@s-t.u-v'",
    "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 1..2.3.4.5 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111112 5 5 4111  1111 41111111111111114111111111111111",
    "+1 (555) 010-9999 +49.30.1234567 +1234 +1(((((((9 ++1 555 010 9999 ü😀 +1 555 010 9999",
    "mail bob [at] example [dot] com, call 555-123-4567, order 555-123-4567, card 4111.1111.1111.1111",
]


def test_base_spans(spark, docs):
    rng = random.Random(5)
    made = ["".join(rng.choice("01 4.-+()@ab_%é") for _ in range(rng.randrange(60))) for _ in range(800)]
    texts = TRICKY + made
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.id: [(s.start, s.kind, s.end) for s in r.base] for r in pii.find_spans(df).select("row.doc_id", "base").withColumnRenamed("doc_id", "id").collect()}
    assert all(got[i] == plain_spans(t) for i, t in enumerate(texts))


def test_disguised_spans_are_added_and_plain_numbers_left(spark, docs, none):
    df = spark.createDataFrame([(1, TRICKY[4])], "doc_id int, text string")
    extra = pii.find_spans(df).first().extra
    assert [TRICKY[4][s.start : s.end] for s in sorted(extra, key=lambda s: s.start)] == ["bob [at] example [dot] com", "555-123-4567", "4111.1111.1111.1111"]
    clean = pii.redact(df).first().text
    assert clean == "mail <email>, call <phone>, order 555-123-4567, card <card>"
    assert pii.redact(docs).count() == docs.count() and pii.redact(docs).columns == docs.columns
    assert pii.find_spans(none).count() == 0


def test_long_texts_take_linear_time(spark):
    made = {  # a few kinds of text that could take quadratic time
        "pairs": lambda n: "see 12, " * n,
        "cards": lambda n: "4111 1111 1111 1111; " * n,
        "mails": lambda n: "a.b@c.de, " * n,
        "phones": lambda n: "call 555-123-4567, " * n,
        "both": lambda n: "bob [at] example [dot] com +49.30.1234567 " * n,
        "run": lambda n: "a" * 8 * n + "@" + "b" * n,
        "open": lambda n: "+1(" + "(" * 8 * n,
        "dots": lambda n: "9." * 4 * n,
    }
    for name, text in made.items():
        took = []
        for n in (8_000, 32_000):
            df = spark.createDataFrame([(1, text(n))], "doc_id int, text string").coalesce(1)
            began = time.time()
            spans = pii.find_spans(df).select(F.size("base") + F.size("extra")).first()[0]
            took.append(time.time() - began)
            assert spans == {"cards": n, "mails": n, "phones": n, "both": 2 * n, "dots": n}.get(name, 0)
        assert took[1] < 6 * took[0], (name, took)


def test_running_sums_and_maxima(spark):
    rng = random.Random(1)
    rows = [(n, [rng.randrange(-50, 50) for _ in range(n)]) for n in (0, 1, 127, 128, 129, 256, 128 * 128 + 1, 40_000)]
    df = spark.createDataFrame(rows, "n int, x array<int>")
    got = {r.n: (r.s, r.m) for r in df.select("n", pii.running(F.col("x"), lambda a, b: a + b).alias("s"), pii.running(F.col("x"), lambda a, b: F.greatest(a, b)).alias("m")).collect()}
    assert got == {n: (list(accumulate(x)), list(accumulate(x, max))) for n, x in rows}


#: Templates that the trees neither see nor are calibrated on.
UNSEEN = {
    "email": (["ask <LLLL(at)LLLL.LLLLL.org> for", "my e-mail <LLLLL [dot] LLL [at] LLLL [dot] net>", "or <LLLLL99{at}LLLLLL.com>"], ["stop <STAND AT LLLLLLLL. LLL> LL", "they <LOOKED AT LLLLL.LLLLLL> LL"]),
    "ip": (["connect to <1N[.]2N[.]1NN[.]NN> LL", "address: <1NN(dot)1NN(dot)NN(dot)N>"], ["LL <8NN[.]NN[.]NN[.]NN>", "ratio <NN(.)NN(.)5NN(.)9NN>"]),
    "card": (["credit card <CCCC/CCCC/CCCC/CCCC>", "LLLL LLLLL <CCCC.CCCC.CCCC.CCCC>", "pay with <CCCC_CCCC_CCCC_CCCC>"], ["sku <NNNN.NNNN.NNNN>", "batch <NNNN_NNNN_NNNN_NNNN> LL", "LLLL <NNNN/NNNNN/NNNNN> LL"]),
    "phone": (["telephone <NNN.NNN.NNNN>", "ring <(NNN) NNN.NNNN> LLL", "whatsapp <0034 NNN NNN NNNN>", "LL <(NNN) NNN NNNN>"], ["order no <NNN-NNN-NNNN>", "price <NNN NNN NNN> LL", "LLL <NNNN NNN NNN> LL", "figure <NN.NNN.NNN> LLL"]),
}


def test_spans_of_unseen_templates(spark):
    rng = random.Random(21)
    made = [(kind, yes, *pii.filled(t, rng)) for kind, sides in UNSEEN.items() for yes, side in zip((True, False), sides) for t in side for _ in range(40)]
    df = spark.createDataFrame([(i, m[2]) for i, m in enumerate(made)], "doc_id int, text string")
    found = {r.doc_id: r.extra + r.base for r in pii.find_spans(df).select("row.doc_id", "base", "extra").collect()}
    told = {}
    for i, (kind, yes, _, start, end) in enumerate(made):
        told.setdefault((kind, yes), []).append(any(s.start < end and start < s.end for s in found[i]))
    recall = {k: np.mean(told[k, True]) for k in UNSEEN}
    wrong = {k: np.mean(told[k, False]) for k in UNSEEN}
    print("recall", recall, "wrong", wrong)
    assert min(recall.values()) >= 0.6 and max(wrong.values()) <= 0.3


def test_boosting_learns_and_column_agrees(spark):
    rng = random.Random(0)
    rows = [(rng.randrange(5), rng.randrange(3), rng.randrange(2)) for _ in range(400)]
    labels = [(a > 2) != (c == 1) for a, b, c in rows]
    model = boosting.fit(rows, labels)
    assert np.mean([(model.score(r) > 0) == y for r, y in zip(rows, labels)]) > 0.98
    df = spark.createDataFrame(rows, "a int, b int, c int")
    got = df.select(model.column([F.col(x) for x in "abc"]).alias("s")).collect()
    assert np.allclose([r.s for r in got], [model.score(r) for r in rows])
    assert boosting.calibrated([3, 2, 1], [True, True, False], 0.9) == 1.5
    assert boosting.calibrated([3, 2], [True, True], 0.9) == 2
    assert boosting.calibrated([1], [False], 0.9) == float("inf")


@pytest.fixture(scope="module")
def speech(spark):
    rng = random.Random(2)
    parts = {"en": ["the", "ing", "on", "th", "er", "wh"], "de": ["sch", "ung", "ei", "der", "ch"], "fr": ["eau", "tion", "é", "que", "ou"]}
    rows = []
    for i in range(900):
        lang = rng.choice(list(parts))
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 60))), lang))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_language_on_held_out_documents(speech):
    held = langid.part(F.col("doc_id"), 4) == 2
    found = langid.identify(speech, speech.filter(~held)).join(speech, F.col("key") == F.col("doc_id")).filter(held)
    assert found.count() > 100
    assert found.filter("lang_pred = lang").count() / found.count() > 0.98
    assert found.filter("score NOT BETWEEN 0 AND 1 OR rejected").count() == 0


def test_language_edges(spark, speech, docs, none):
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!!"), (4, "zzxq qqjz vvkx " * 40), (5, "the thing on")], "doc_id bigint, text string")
    got = {r.key: r for r in langid.identify(odd, speech).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0.0
    assert got[4].rejected and not got[5].rejected and got[5].lang_pred == "en"
    assert {r.lang_pred for r in langid.identify(odd, speech.filter("false")).collect()} == {"und"}
    assert langid.identify(none, speech).count() == 0
    kept = langid.accepted(docs)
    assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
    assert langid.accepted(none).count() == 0


def plain_kneser_ney(counts, alphabet):
    """P(symbol | symbols before it in the word) by interpolated Kneser-Ney of order 5, straight from its definition."""
    level, above = {}, None
    for n in range(5, 0, -1):
        a = Counter()
        if above is not None:
            for gram in above:
                a[gram[1:]] += 1
        for w, c in counts.items():
            x = f"\x02{w}\x03"
            for end in range(1, len(x)):
                if (end >= n - 1) if n == 5 else (end == n - 1):
                    a[x[end - n + 1 : end + 1]] += c
        once, twice = sum(v == 1 for v in a.values()), sum(v == 2 for v in a.values())
        level[n] = (a, once / (once + 2 * twice) if once and twice else 0.5)
        above = a

    def p(symbol, before, n=5):
        if not n:
            return 1 / alphabet
        if n > len(before) + 1:
            return p(symbol, before, n - 1)
        context = before[len(before) - n + 1 :]
        a, discount = level[n]
        same = {g: v for g, v in a.items() if g[:-1] == context}
        total = sum(same.values())
        lower = p(symbol, before, n - 1)
        return max(a.get(context + symbol, 0) - discount, 0) / total + discount * len(same) / total * lower if total else lower

    return p


def test_kneser_ney_against_its_definition():
    counts = {"x": {"abab": 3, "ba": 2, "aab": 1, "abcabcab": 2}, "y": {"bbb": 2, "ab": 1, "cab": 1}}
    models = langid.fit(counts)
    assert models.alphabet == 5
    for column, name in enumerate(models.languages):
        plain = plain_kneser_ney(counts[name], models.alphabet)
        for prefix in ("", "a", "ab", "aba", "abca", "abcabca", "zz", "cz"):
            total = 0.0
            for symbol in ("a", "b", "c", "z", ""):  # z: a letter that was never seen; "": the end of the word
                if not prefix + symbol:  # a word has a letter
                    total += plain("\x03", "\x02")
                    continue
                logp, _ = models.symbols([prefix + symbol])
                got = np.exp(logp[len(prefix), column])
                assert np.isclose(got, plain(symbol or "\x03", "\x02" + prefix), rtol=1e-4), (name, prefix, symbol)
                total += got
            assert np.isclose(total, 1, atol=1e-4), (name, prefix)


def test_language_of_repeated_rows_and_ties(spark):
    rows = [(i % 7, "same words here", lang) for i in range(80) for lang in ("aa", "bb")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = langid.identify(df, df).collect()
    assert len(got) == 160 and {r.lang_pred for r in got} <= {"aa", "bb"} and all(0 < r.score <= 1 for r in got)


def plain_fingerprint(text):
    votes, total = [0] * 64, 0
    for term in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()):
        w = min(len(term), 8) ** 2
        h = xxhash.xxh64_intdigest(term.encode(), seed=42)
        total += w
        for b in range(64):
            votes[b] += w * (h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * votes[b] > total)


def test_edited_fingerprints(docs, doc_rows, none, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 9)
    got = fingerprints.edited_fingerprints(docs).collect()
    order = sorted(((d if d is not None else -(1 << 63)), t or "") for d, t, *_ in doc_rows)
    want = []
    for i, (d, t) in enumerate(order):
        q = len(t) // 4
        edited = t[: len(t) - q] + order[(i + 1) % len(order)][1][:q]
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), *(plain_fingerprint(x) for x in (t, edited, order[(i + 1) % len(order)][1]))))
    unsigned = lambda x: x % (1 << 64)
    assert sorted(((r.doc_id if r.doc_id is not None else -(1 << 63)), r.n_chars, r.edited_sha256, unsigned(r.fp), unsigned(r.edited_fp), unsigned(r.next_fp)) for r in got) == sorted(want)
    assert fingerprints.edited_fingerprints(none).count() == 0
    assert fingerprints.edited_fingerprints(docs.limit(1)).count() == 1


def test_within_radius(spark, monkeypatch):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(60)]
    all_ = base + [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(5)] + base[:5]
    signed = lambda x: x - (1 << 64) * (x >> 63)
    df = spark.createDataFrame([(signed(x),) for x in all_] + [(None,)], "fp bigint")
    for radius, crowd in ((0, 100), (3, 100), (3, 2)):
        monkeypatch.setattr(fingerprints, "CROWD", crowd)
        got = {(r.query_fp, r.fp, r.distance) for r in fingerprints.within_radius(df.limit(20), df, radius).collect()}
        want = {(signed(a), signed(b), (a ^ b).bit_count()) for a in all_[:20] for b in all_ if (a ^ b).bit_count() <= radius}
        assert got == want


def test_query_counts_neighbours(spark, tmp_path):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(20)]
    for t in texts[:]:
        for _ in range(6):
            parts = t.split(" ")
            parts[rng.randrange(200)] = rng.choice(words)
            texts.append(" ".join(parts))
    rows = [(i, t) for i, t in enumerate([*texts, None, texts[0]])] + [(None, texts[1]), (7, texts[2])]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    fps = [(d, plain_fingerprint(t)) for d, t in rows]
    want = Counter()
    for d, f in fps:
        near = {g: min((e for e, x in fps if x == g and e is not None), default=None) for _, g in fps if 0 < (f ^ g).bit_count() <= 3}
        want[d, f, len(near), min((x for x in near.values() if x is not None), default=None)] += 1
    got = Counter((r.doc_id, int(r.fingerprint, 16), r.n_near, r.first_near) for r in fingerprints.op3_fingerprint(spark, str(tmp_path)).collect())
    assert got == want and sum(k[2] for k in want) > 20


def test_licenses(spark, docs, none):
    mit = dict((t, k) for k, t in licenses.KNOWN)
    text = "Copyright (c) 1999 Somebody\n\n" + licenses._MIT.upper().replace(",", " ,").replace("\n\n", "\n")
    bare = "Copyright (c) The Authors of Something\n© nobody\n" + licenses._MIT
    rows = [(6, bare), (1, text), (2, "Intro.\nlicensed under the APACHE LICENCE, version 2.0\nEnd."), (3, None), (4, "nothing"), (5, licenses._MIT + " more")]
    got = {(r.doc_id, r.line): r.license_id for r in licenses.scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got[6, 0] == got[1, 0] == "MIT" and got[2, 2] == "Apache-2.0"
    assert [got[i, 0] for i in (2, 3, 4, 5)] == [None] * 4 and mit
    assert licenses.scan(docs).filter("line = 0").count() == docs.count()
    assert licenses.scan(none).count() == 0


def test_whole_license_texts(spark):
    folder = Path("/usr/share/common-licenses")
    names = {"Apache-2.0": "Apache-2.0", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    found = {i: (folder / f).read_text() for f, i in names.items() if (folder / f).exists()}
    if not found:
        pytest.skip("no licence texts on this machine")
    rows = [(i, "\n" + t.upper().replace("  ", " \t ")) for i, t in found.items()] + [(f"not {i}", t + " more") for i, t in found.items()]
    got = {r.doc_id: r.license_id for r in licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).filter("line = 0").collect()}
    assert got == {i: i for i in found} | {f"not {i}": None for i in found}


def test_own_table_of_known_texts(spark):
    own = licenses.digests(spark.createDataFrame([("House-1", "Do what you like, (C) 2020."), ("House-2", None)], "license_id string, text string"))
    docs = spark.createDataFrame([(1, "do WHAT you like -- (c) 2020"), (2, "x\nDo what you like (c) 2020\n"), (3, licenses._MIT)], "doc_id int, text string")
    got = {(r.doc_id, r.line): r.license_id for r in licenses.scan(docs, table_=own).collect()}
    assert got == {(1, 0): "House-1", (1, 1): "House-1", (2, 0): None, (2, 2): "House-1", (3, 0): None}


def test_license_anchors_cover_what_they_stand_for(spark):
    known = spark.createDataFrame(licenses.KNOWN, "k string, t string").select(licenses.canonical(F.lower("t")).alias("form")).collect()
    assert all(any(a in r.form for a in licenses.KNOWN_ANCHORS) for r in known)
    samples = ["http://x", "https://x", "a & b", "licence", "sub-licens", "sub licens", "non-commercial", "non commercial", "non-infringement", "non infringement", "copyright holders", "copyright owners", "merchantibility", "per cent", "(c) 1999 x", "© 2000 y", "all rights reserved", "copyright 2001"]
    assert all(any(a in s for a in licenses.SPELLING_ANCHORS) for s in samples)


def test_license_sql(spark, docs, doc_rows):
    import pandas as pd

    rows = [(d, t) for d, t, *_ in doc_rows] + [(5000, "x\nLicensed under the MIT License.\n\nLicensed under CC0 1.0"), (5001, "© 2020 A\n" + licenses._ZLIB), (5001, licenses._ZLIB)]
    connection = duckdb.connect()
    connection.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    want = Counter(tuple(None if x is pd.NA else x for x in r) for r in connection.execute(licenses.OP7_SQL).fetchall())
    got = Counter((r.doc_id, r.line, r.digest, r.license_id) for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == want and sum(k[3] is not None for k in got) == 4


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab@.+-_ ", max_size=40))
def test_email_pattern_matches_plain_one(text):
    # Python has no \G; the rest of the possessive pattern is checked here
    ours = pii.BASE["email"].replace(r"(?:\G|(?<![A-Za-z0-9._%+-]))", "")
    assert [m.span() for m in re.finditer(ours, text)] == [m.span() for m in re.finditer(PATTERNS[0], text)]
