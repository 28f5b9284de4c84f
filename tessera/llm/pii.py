"""Personal data: candidate spans by patterns, boosted trees on format and context, calibrated thresholds.

Two layers, both in DataFrame functions over one row at a time (no shuffle):

* base spans by fixed patterns (email, ip, card, phone), with their checks;
* further candidates by high-recall patterns (disguised addresses, national
  phone numbers, grouped card numbers). Each gets format and context features;
  boosted trees score it, and it becomes a span if its score reaches the
  threshold of its kind, which was set on held-out labelled candidates for a
  precision. Of overlapping ones the best stays; base spans always stay.

The trees are fitted on the driver on TRAINING_TEXTS made-up labelled texts,
never on the corpus: half of the templates fit, the other half calibrate.
Patterns are possessive or bounded, offsets, context and overlaps are found by
runs over bounded chunks, so time is linear in the text whatever it holds.

Null texts count as empty; ids may be null or repeat; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.boosting import calibrated, fit
from tessera.llm.common import let, table

KINDS = ("email", "ip", "card", "phone")
#: Base patterns. A run is entered at its start only, or where the last match ended, and never given back.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",  # shorter runs fail the check
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: High-recall candidates beside the base.
LOOSE = {
    "email": r"[A-Za-z0-9._%+-]{1,64}+ ?(?:\[at\]|\(at\)|\{at\}|\[AT\]|\(AT\)|(?<= )AT(?= )) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\[dot\]|\(dot\)|\{dot\}|\[DOT\]|\(DOT\)|(?<= )DOT(?= )|\.) ?[A-Za-z0-9-]{2,63}+){1,6}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\)|\[dot\]|\(dot\))[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}[._/][0-9]{4,6}[._/][0-9]{4,5}(?:[._/][0-9]{1,4})?(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z.+/-])(?:00[1-9][0-9]{0,2}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z]|[.-][0-9])",
}
OCTETS = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"
#: Context words, by kind, and those that speak against any.
CUES = {
    "email": r"(?i)(?:mail|contact|write|reach|correo|courriel|kontakt)",
    "ip": r"(?i)(?:\bip\b|host|server|address|login|ping|from)",
    "card": r"(?i)(?:card|visa|credit|amex|payment|charged|karte|carte|tarjeta)",
    "phone": r"(?i)(?:phone|\btel|call|fax|mobile|cell|whatsapp|contact|reach|appel|telefon)",
}
AGAINST = r"(?i)(?:version|order|isbn|issn|invoice|ref\b|\bid\b|serial|page|item|build|sku|part no|total|price|figure|score)"
BEFORE, CLOSE, AFTER = 32, 10, 12
TRAINING_TEXTS = 1600
FEATURES = 16
PRECISION = 0.95
#: Elements of one fold, code points of a piece of text.
RUN, PIECE = 128, 1024
#: Candidates that can overlap one on each side: 8 code points or more each and at most 560, in four kinds.
REACH = 4 * 560 // 8


def running(values: Column, join: Callable[[Column, Column], Column], levels: int = 2) -> Column:
    """Running sums (or maxima, as ``join`` says) of an array of integers. A fold copies its list at each step, so it runs over chunks of RUN, whose totals are run in the same way."""
    none = F.array().cast("array<int>")

    def fold(x: Column) -> Column:
        def step(s: Column, v: Column) -> Column:
            return F.concat(s, F.array(F.when(F.size(s) > 0, join(F.element_at(s, -1), v)).otherwise(v)))

        return F.aggregate(x, none, step)

    def chunked(x: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / RUN).cast("int")), lambda i: fold(F.slice(x, i * RUN + 1, F.lit(RUN))))

        def lifted(parts: Column) -> Column:
            before = running(F.transform(parts, lambda p: F.element_at(p, -1)), join, levels - 1)
            return let(before, lambda b: F.flatten(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.transform(p, lambda v: join(F.get(b, i - 1), v))))))

        return let(parts, lifted)

    return fold(values) if not levels else let(values, lambda x: F.when(F.size(x) <= RUN, fold(x)).otherwise(chunked(x)))


def pieces(text: Column) -> Column:
    """The text in pieces of PIECE code points, so that any part of it is reached without walking from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def between(chunks: Column, start: Column, end: Column) -> Column:
    """Code points from ``start`` to ``end`` of a text of these :func:`pieces`."""
    first = F.floor(start / PIECE).cast("int")
    some = F.array_join(F.slice(chunks, first + 1, F.floor(end / PIECE).cast("int") - first + 1), "")
    return F.substring(some, start - first * PIECE + 1, end - start)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    size = F.length(d)

    def step(total: Column, i: Column) -> Column:
        x = F.substring(d, size - i + 1, F.lit(1)).cast("int")
        double = 2 * x - 9 * (x > 4).cast("int")
        return total + F.when(i % 2 == 0, double).otherwise(x)

    sound = size.between(12, 19)
    return F.when(sound, F.aggregate(F.sequence(F.lit(1), F.when(sound, size).otherwise(1)), F.lit(0), step) % 10 == 0).otherwise(False)


def _passes(kind: str, m: Column) -> Column:
    d = _digits(m)
    return {"email": F.lit(True), "ip": m.rlike(OCTETS), "card": F.length(d).between(14, 19) & _luhn(d), "phone": F.length(d).between(10, 15)}[kind]


def _check(kind: str) -> Callable[[Column], Column]:
    return lambda x: _passes(kind, x["m"])


def _of_kind(kind: int) -> Callable[[Column], Column]:
    return lambda x: x["kind"] == kind


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """All matches of a pattern as structs with code point offsets: gaps between matches come from the split text."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern)
    steps = F.transform(F.arrays_zip(found.alias("m"), F.slice(gaps, 1, F.size(found)).alias("gap")), lambda p: F.struct(p["m"].alias("m"), F.length(p["m"]).alias("own"), (F.length(p["gap"]) + F.length(p["m"])).alias("all")))

    def placed(steps: Column) -> Column:
        ends = running(F.transform(steps, lambda p: p["all"]), lambda a, b: a + b)
        return F.zip_with(steps, ends, lambda p, end: F.struct((end - p["own"]).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), p["m"].alias("m")))

    return let(steps, placed)


def _features(c: Column, before: Column, after: Column) -> list[Column]:
    """Of a candidate between at most BEFORE code points and AFTER ones."""
    d = _digits(c["m"])
    close = F.right(before, F.lit(CLOSE))
    cue, close_cue = F.lit(False), F.lit(False)
    for i, k in enumerate(KINDS):
        cue = F.when(c["kind"] == i, before.rlike(CUES[k])).otherwise(cue)
        close_cue = F.when(c["kind"] == i, close.rlike(CUES[k])).otherwise(close_cue)
    marks = F.regexp_replace(c["m"], "[A-Za-z0-9()]", "")
    plain = [
        c["kind"],
        F.length(d),
        _luhn(d),
        cue,
        before.rlike(AGAINST),
        F.length(marks),
        F.length(F.regexp_replace(marks, r"(.)\1*", "$1")),
        before.rlike(r"[$€£#=:/_]\s?$"),
        after.rlike(r"^\s?[%€$£]|^[/_=-]"),
        c["m"].rlike(r"^(?:4[0-9]{3}|5[1-5][0-9]{2}|3[47][0-9]{2}|6011)"),
        c["m"].rlike(r"^\([0-9]{3}\)|^[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}$|^00"),
        F.regexp_replace(c["m"], r"[\[(](?:\.|dot)[\])]", ".").rlike(OCTETS),
        c["m"].rlike(r"(?i)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$"),
        c["m"].rlike(r"[\[({](?i:at)[\])}]"),
        close_cue,
        close.rlike(AGAINST),
    ]
    return [x.cast("int") for x in plain]


def featured(loose: Column, chunks: Column) -> Column:
    """Structs ``start, kind, end, m, f`` of candidates in a text of these :func:`pieces`."""

    def one(c: Column) -> Column:
        before = between(chunks, F.greatest(c["start"] - BEFORE, F.lit(0)), c["start"])
        after = between(chunks, c["end"], c["end"] + AFTER)
        features = let(F.struct(before.alias("before"), after.alias("after")), lambda x: F.array(*_features(c, x["before"], x["after"])))
        return F.struct(*(c[x].alias(x) for x in ("start", "kind", "end", "m")), features.alias("f"))

    return F.transform(loose, one)


def candidates(text: Column) -> Column:
    """Structs ``start, kind, end, m`` by the loose patterns."""
    guard = {
        "email": text.rlike(r"(?i)[\[({]at[\])}]") | text.contains(" AT "),
        "ip": text.rlike(r"[0-9][\[(](?:\.|dot)[\])][0-9]"),
        "card": text.rlike(r"[0-9]{4}[._/][0-9]{4}"),
        "phone": text.rlike(r"[0-9]{3}[ .-][0-9]{3}"),
    }
    none = F.array().cast("array<struct<start:int,kind:int,end:int,m:string>>")
    return F.concat(*(F.when(guard[k], _matches(text, k, LOOSE[k])).otherwise(none) for k in KINDS))


def base_spans(text: Column) -> Column:
    """Structs ``start, kind, end, m`` by the base patterns and checks, sorted by start, then kind."""
    guard = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9]"), "phone": text.contains("+")}
    none = F.array().cast("array<struct<start:int,kind:int,end:int,m:string>>")
    each = [F.when(guard[k], F.filter(_matches(text, k, BASE[k]), _check(k))).otherwise(none) for k in KINDS]
    return F.array_sort(F.concat(*each))


#: What stands before a candidate of a made-up text: words that speak for its kind, none, words that speak against any.
#: N is any digit, L a letter, C a digit of a valid card.
FOR = {
    "email": ("mail me: ", "contact ", "write to ", "reach us: LLL "),
    "ip": ("login from IP ", "host ", "server LLLL ", "ping "),
    "card": ("card ", "visa: ", "charged to ", "payment LLLL "),
    "phone": ("call ", "phone: ", "tel ", "my cell is ", "fax LLL "),
}
NEUTRAL = ("LLLL LLL ", "LL ", "LLLLLL, LLLLL ", "LLLL LLLLLLL LL. LLLLL ")
OTHERWISE = ("order ", "version ", "ref ", "invoice LLL ", "serial ", "item ", "page ", "total $ ")
#: Formats by kind: data wherever they stand, data unless words speak against it, data only where words speak for it, never.
FORMATS = {
    "email": (["LLLLL [at] LLLLLL [dot] com", "LLLL.LLL(at)LLLLLL.org", "LLLLL {at} LLLLL {dot} de", "LLLLLL[at]LLLLLLL.net", "LLLL99(at)LLLL(dot)LLLLL(dot)com", "LLLL [AT] LLLLL [DOT] info", "LLLLLL AT LLLLL DOT net"], [], ["LLLLL AT LLLLLL.com"], ["LLLL AT LLLLL. LLLL", "NNN AT LLLLLL.LLLL", "LOOK AT LLLL AT LLLLL.LLLLLL"]),
    "ip": (["1N[.]1NN[.]2N[.]1NN", "1NN(dot)1N(dot)N(dot)1N", "1NN[dot]1N[dot]N[dot]NN", "1N(.)NN(.)1NN(.)N", "1N.1NN[.]2N.1NN"], [], [], ["9NN[.]8NN[.]7NN[.]6NN", "7NN(dot)NN(dot)9NN(dot)N", "4NN(.)9NN.NN.NN"]),
    "card": ([], ["CCCC.CCCC.CCCC.CCCC", "CCCC/CCCC/CCCC/CCCC", "CCCC_CCCC_CCCC_CCCC"], [], ["NNNN.NNNN.NNNN.NNN", "NNNN_NNNN_NNNN", "NNNN/NNNNN/NNNN", "NNNN.NNNN.NNNN.NNNN", "NNNN/NNNN/NNNN"]),
    "phone": ([], ["(NNN) NNN-NNNN", "0049 NNN NNN NNNN", "0033 NNN NNN NNN", "(NNN) NNN NNNN"], ["NNN-NNN-NNNN", "NNN.NNN.NNNN", "NNN NNN NNNN"], ["NNNN-NNN-NNN", "NN-NNN-NNN", "NNNN NNNN NNNN", "(NNN) NNN-NNN", "NNN NNN NNN", "NN.NNN.NNNN"]),
}


def templates(kind: str) -> list[tuple[str, bool, bool]]:
    """Templates with their candidate marked, whether it is personal data, and whether to fit on it: every second pair of format and context does."""
    out = []
    for level, formats in enumerate(FORMATS[kind]):
        for i, form in enumerate(formats):
            for j, (context, side) in enumerate([(c, 0) for c in FOR[kind]] + [(c, 1) for c in NEUTRAL] + [(c, 2) for c in OTHERWISE]):
                out.append((f"{context}<{form}> LLLL", side <= (2, 1, 0, -1)[level], (i + j) % 2 == 0))
    return out


def filled(template: str, rng: random.Random) -> tuple[str, int, int]:
    """A text of a template, and its marked span."""
    body = [rng.randrange(10) for _ in range(15)]
    body[0] = rng.choice((4, 4, 5, 6))
    body[1] = rng.choice((1, 2, 3, 4, 5)) if body[0] == 5 else body[1]
    total = sum(x if i % 2 else (2 * x - 9 * (x > 4)) for i, x in enumerate(body))
    card = iter([*body, -total % 10])
    before, marked, after = ("".join(str(rng.randrange(10)) if c == "N" else rng.choice("abdefghiklmoprstuvw") if c == "L" else str(next(card)) if c == "C" else c for c in x) for x in _split(template))
    # words of context that belong to something else, further away
    lead = rng.choice(("", "", "order 12, ", "page 7: ", "the total. ", "call me, ", "by mail; ", "version 2, ", "a card, ", "the server ")) + "".join(rng.choice("aeinorst ") for _ in range(rng.randrange(8, 30))) + " " + before
    return lead + marked + after, len(lead), len(lead) + len(marked)


def _split(template: str) -> tuple[str, str, str]:
    before, rest = template.split("<")
    marked, after = rest.split(">")
    return before, marked, after


def labelled_texts(n: int = TRAINING_TEXTS, seed: int = 7) -> list[tuple[str, int, int, bool, bool]]:
    """Made-up texts, each with one candidate at (start, end), whether it is personal data, and whether to fit on it. No template is on both sides."""
    rng = random.Random(seed)
    by_kind, out = [templates(k) for k in KINDS], []
    for i in range(n):
        personal, fitted = i % 2 == 0, i // 2 % 2 == 0
        template = rng.choice([t for t, y, f in by_kind[i // 4 % 4] if y is personal and f is fitted])
        out.append((*filled(template, rng), personal, fitted))
    return out


@lru_cache(maxsize=1)
def _model(session_id: int):
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    made = labelled_texts()
    texts = spark.range(1).select(F.posexplode(F.split(F.lit("\x1e".join(t for t, *_ in made)), "\x1e")).alias("i", "text"))
    found = texts.select("i", F.explode(featured(candidates(F.col("text")), pieces(F.col("text")))).alias("c")).select("i", "c.start", "c.end", "c.kind", "c.f")
    rows = sorted(found.collect())  # bounded: a few candidates in each of TRAINING_TEXTS texts
    right = [made[r.i][3] and r.start < made[r.i][2] and r.end > made[r.i][1] for r in rows]
    features = [tuple(r.f) for r in rows]
    fitted = [made[r.i][4] for r in rows]
    model = fit([x for x, a in zip(features, fitted) if a], [y for y, a in zip(right, fitted) if a])
    bar = []
    for k in range(len(KINDS)):
        own = [i for i, r in enumerate(rows) if not fitted[i] and r.kind == k]
        bar.append(max(0.0, calibrated([model.score(features[i]) for i in own], [right[i] for i in own], PRECISION)))  # at least even odds
    return model, tuple(bar)


def _apart(spans: Column, base: Column) -> Column:
    """Those of ``spans`` that overlap none of ``base``; both sorted by start. Running ends and starts over both in one order, so the work is linear."""

    def marked(x: Column, own: bool) -> Column:
        return F.transform(x, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), c["m"].alias("m"), (c["score"] if own else F.lit(None).cast("double")).alias("score")))

    def sifted(both: Column) -> Column:
        covered = running(F.transform(both, lambda c: F.when(c["score"].isNull(), c["end"]).otherwise(0)), lambda a, b: F.greatest(a, b))
        following = F.reverse(running(F.transform(F.reverse(both), lambda c: F.when(c["score"].isNull(), -c["start"]).otherwise(-(1 << 30))), lambda a, b: F.greatest(a, b)))
        joined = F.arrays_zip(both.alias("c"), covered.alias("covered"), following.alias("following"))
        free = F.filter(joined, lambda x: x["c"]["score"].isNotNull() & (x["covered"] <= x["c"]["start"]) & (-x["following"] >= x["c"]["end"]))
        return F.transform(free, lambda x: x["c"])

    return let(F.array_sort(F.concat(marked(spans, True), marked(base, False))), sifted)


def _best(free: Column) -> Column:
    """Those that overlap no better one. Candidates are bounded in length and of one kind never overlap, so only REACH neighbours on each side can."""

    def beaten(c: Column, o: Column) -> Column:
        return (o["start"] < c["end"]) & (c["start"] < o["end"]) & ((o["score"] > c["score"]) | ((o["score"] == c["score"]) & (o["kind"] < c["kind"])))

    def near(free: Column, i: Column) -> Column:
        return F.slice(free, F.greatest(i + 1 - REACH, F.lit(1)), F.lit(2 * REACH + 1))

    return let(free, lambda x: F.filter(x, lambda c, i: ~F.exists(near(x, i), lambda o: beaten(c, o))))


def find_spans(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as ``row, text, base, extra``: arrays of structs ``start, kind, end, m``, each sorted by start, then kind."""
    model, bar = _model(id(docs.sparkSession))
    rows = docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("row", "text", base_spans(F.col("text")).alias("base"), candidates(F.col("text")).alias("loose"))

    def high(c: Column) -> Column:
        out = F.lit(False)
        for k, least in enumerate(bar):
            out = out | ((c["kind"] == k) & (c["score"] >= F.lit(least)))
        return out

    def chosen(chunks: Column) -> Column:
        scored = F.transform(
            featured(F.col("loose"), chunks),
            lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), c["m"].alias("m"), model.column([c["f"][i] for i in range(FEATURES)]).alias("score")),
        )
        best = _best(_apart(F.filter(scored, high), F.col("base")))
        return F.transform(best, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), c["m"].alias("m")))

    none = F.array().cast("array<struct<start:int,kind:int,end:int,m:string>>")
    extra = F.when(F.size("loose") > 0, let(pieces(F.col("text")), chosen)).otherwise(none)
    return rows.select("row", "text", "base", extra.alias("extra"))


def _listed(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in angle brackets; overlapping spans become one, of the first's kind."""
    names = F.array(*(F.lit(f"<{k}>") for k in KINDS))

    def cut(chunks: Column, spans: Column) -> Column:
        ends = running(F.transform(spans, lambda x: x["end"]), lambda a, b: F.greatest(a, b))

        def joined(ends: Column) -> Column:
            before = F.concat(F.array(F.lit(0)), ends)
            own = F.filter(F.arrays_zip(spans.alias("x"), F.slice(before, 1, F.size(ends)).alias("at")), lambda p: p["x"]["start"] >= p["at"])
            text = F.transform(own, lambda p: F.concat(between(chunks, p["at"], p["x"]["start"]), F.get(names, p["x"]["kind"])))
            return F.concat(F.array_join(text, ""), between(chunks, F.element_at(ends, -1), F.size(chunks) * PIECE))

        return let(ends, joined)

    found = find_spans(docs).withColumn("spans", F.array_sort(F.concat("base", "extra")))
    done = let(pieces(F.col("text")), lambda chunks: cut(chunks, F.col("spans")))
    kept = found.select("row", F.when(F.size("spans") > 0, done).otherwise(F.col("row.text")).alias("clean"))
    return kept.select(F.col("row").withField("text", F.col("clean")).alias("row")).select("row.*")


def op1_redact_pii(spark, sf_dir) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    everything = F.array_sort(F.concat("base", "extra"))
    return found.select(F.col("row.doc_id").alias("doc_id"), *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(everything).alias("spans"))
