"""Language identification by interpolated Kneser-Ney character models.

Each language gets a character n-gram model (order ORDER, over words between
word marks), estimated by interpolated Kneser-Ney smoothing: raw counts at the
highest order and at word starts, numbers of distinct left neighbours below,
one absolute discount per order. For every order, the n-grams of all languages
are held in one sorted array of 64-bit hashes beside a row of log probabilities
per language; contexts and their back-off weights likewise. A document's
language is the one of least cross-entropy per symbol; ties go to the lesser
name. It is rejected when even that cross-entropy lies too far above what
documents of the language have (calibrated on labelled documents that the
models were not fitted on) and half-way to that of random letters, or when it
has no letter.

The models are fitted on a sample of labelled rows: at most DOCS_PER_LANGUAGE
documents a language, DOCS and CODE_POINTS in all, chosen by a hash of the id,
of the LANGUAGES most frequent labels (rows of others teach nothing). Every
document is scored over its whole text. Work per task is bounded by an Arrow
batch and a cache of CACHE words.

Null texts, and texts without a letter, get ``und`` with score 0; so does every
text when nothing is labelled. Null labels teach nothing. Ids may be null or
repeat. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, table

ORDER = 5
DOCS_PER_LANGUAGE, DOCS = 1500, 30_000
#: Code points to fit on, in all (in expectation: documents are taken whole), and labels that are told apart, most frequent first.
CODE_POINTS, LANGUAGES = 120_000_000, 500
CACHE = 300_000
#: Words scored at once, and symbols beyond which a text counts as long when it may be rejected: texts of one language
#: differ in what they are about, so the spread of their cross-entropy does not shrink further with their length.
AT_ONCE, LONG = 20_000, 400
#: Distance above a language's mean cross-entropy that is still accepted, in units of the largest seen in calibration.
MARGIN = 2.0
#: A text is rejected only if its cross-entropy is also beyond this part of the way from the language's mean to that of random letters.
FLOOR = 0.5
UNKNOWN = "und"
START, END = "\x02", "\x03"
STEP = np.uint64(0x9E3779B97F4A7C15)
RUN = regex.compile(r"\p{L}+")


def _symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the words' letter runs with marks, each one's place in its run, and its word's number."""
    runs = [[f"{START}{r}{END}" for r in RUN.findall(w)] for w in words]
    lengths = [sum(map(len, r)) for r in runs]
    joined = "".join(chain.from_iterable(runs))
    x = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.uint64)
    start = np.flatnonzero(x == ord(START))
    place = np.arange(len(x)) - np.repeat(start, np.diff(np.append(start, len(x))))
    return x, place, np.repeat(np.arange(len(words)), lengths)


def _grams(x: np.ndarray) -> list[np.ndarray]:
    """Hash of the n symbols that end at each place, for n = 0 to ORDER."""
    out = [np.zeros(len(x), np.uint64)]
    for _ in range(ORDER):
        before = np.concatenate([np.zeros(1, np.uint64), out[-1][:-1]])
        out.append(before * STEP + x + np.uint64(1))
    return out


@dataclass
class Level:
    """N-grams of one order: sorted hashes, those of their contexts and suffixes, log probabilities by language; contexts' hashes and log back-off weights."""

    keys: np.ndarray
    logp: np.ndarray
    contexts: np.ndarray
    weights: np.ndarray


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


@dataclass
class Models:
    languages: list[str]
    alphabet: int
    levels: list[Level]
    mean: np.ndarray | None = None
    limit: np.ndarray | None = None

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities by symbol (letters and word ends, in order) and language, and each symbol's word."""
        x, place, word = _symbols(words)
        grams = _grams(x)
        said = np.flatnonzero(place > 0)
        total = np.zeros((len(said), len(self.languages)), np.float32)
        open_ = np.arange(len(said))
        for n in range(ORDER, 0, -1):
            level = self.levels[n]
            reach = place[said[open_]] >= n - 1
            mine = open_[reach]
            at, found = _find(level.keys, grams[n][said[mine]])
            total[mine[found]] += level.logp[at[found]]
            missing = mine[~found]
            at, seen = _find(level.contexts, grams[n - 1][said[missing] - 1])
            total[missing[seen]] += level.weights[at[seen]]
            open_ = np.concatenate([open_[~reach], missing])
        total[open_] -= np.log(self.alphabet)
        return total, word[said]

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities by word and language, and symbols by word."""
        total, word = self.symbols(words)
        out = np.zeros((len(words), len(self.languages)), np.float32)
        np.add.at(out, word, total)
        return out, np.bincount(word, minlength=len(words))


def fit(counts: dict[str, dict[str, int]]) -> Models:
    """Models from word counts by language."""
    languages = sorted(counts)
    per = []
    letters = set()
    for name in languages:
        words = sorted(counts[name])
        letters |= set("".join(words))
        x, place, word = _symbols(words)
        grams, weight = _grams(x), np.array([counts[name][w] for w in words])[word]
        prefix = [np.concatenate([np.zeros(1, np.uint64), g[:-1]]) for g in grams]
        levels: list[tuple] = [()] * (ORDER + 1)
        above: np.ndarray | None = None  # a place of each n-gram of the order above
        for n in range(ORDER, 0, -1):
            raw = np.flatnonzero((place == n - 1) & (place > 0)) if n < ORDER else np.flatnonzero((place >= n - 1) & (place > 0))
            at, mass = raw, weight[raw]
            if above is not None:
                at, mass = np.concatenate([above, raw]), np.concatenate([np.ones(len(above), np.int64), mass])
            keys, first, where = np.unique(grams[n][at], return_index=True, return_inverse=True)
            a = np.bincount(where, mass, len(keys))
            above = at[first]
            once, twice = (a == 1).sum(), (a == 2).sum()
            discount = once / (once + 2 * twice) if once and twice else 0.5
            contexts, which = np.unique(prefix[n - 1][above], return_inverse=True)
            sums, kinds = np.bincount(which, a), np.bincount(which)
            levels[n] = (keys, prefix[n - 1][above], grams[n - 1][above], np.maximum(a - discount, 0) / sums[which], contexts, np.log(discount * kinds / sums))
        per.append(levels)
    alphabet = len({c for w in letters for c in w}) + 2
    out = [Level(np.zeros(0, np.uint64), np.zeros((0, 0)), np.zeros(0, np.uint64), np.zeros((0, 0)))]
    for n in range(1, ORDER + 1):
        keys, first = np.unique(np.concatenate([m[n][0] for m in per]), return_index=True)
        context = np.concatenate([m[n][1] for m in per])[first]
        suffix = np.concatenate([m[n][2] for m in per])[first]
        contexts = np.unique(np.concatenate([m[n][4] for m in per]))
        weights = np.zeros((len(contexts), len(per)), np.float32)
        logp = np.zeros((len(keys), len(per)), np.float32)
        for i, m in enumerate(per):
            weights[np.searchsorted(contexts, m[n][4]), i] = m[n][5]
            lower = np.full(len(keys), -np.log(alphabet)) if n == 1 else out[n - 1].logp[np.searchsorted(out[n - 1].keys, suffix), i]
            backed = weights[np.searchsorted(contexts, context), i] + lower
            own = np.zeros(len(keys))
            own[np.searchsorted(keys, m[n][0])] = m[n][3]
            logp[:, i] = np.log(own + np.exp(backed))
        out.append(Level(keys, logp, contexts, weights))
    return Models(languages, alphabet, out)


def _words(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            by.setdefault(lang, Counter()).update(_words(text))
        for lang, c in by.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["lang", "word", "n"])


class Scorer:
    """Scores texts with a bounded cache of words."""

    def __init__(self, models: Models):
        self.models, self.at = models, {}
        self.logp = np.zeros((0, len(models.languages)), np.float32)
        self.size = np.zeros(0, np.int64)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Mean log probability by text and language, and symbols by text."""
        listed = [_words(t) for t in texts]
        new = [w for w in set(chain.from_iterable(listed)) if w not in self.at]
        if len(self.at) + len(new) > CACHE:
            self.at, self.logp, self.size = {}, self.logp[:0], self.size[:0]
            new = list(set(chain.from_iterable(listed)))
        if new:
            made = [self.models.words(new[i : i + AT_ONCE]) for i in range(0, len(new), AT_ONCE)]
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new))))
            self.logp = np.concatenate([self.logp, *(m[0] for m in made)])
            self.size = np.concatenate([self.size, *(m[1] for m in made)])
        out, n = np.zeros((len(texts), len(self.models.languages))), np.zeros(len(texts), np.int64)
        for i, words in enumerate(listed):
            ids = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
            n[i] = self.size[ids].sum()
            if n[i]:
                out[i] = np.bincount(ids, minlength=0)[None, :] @ self.logp[: ids.max() + 1] / n[i] if len(ids) > 50_000 else self.logp[ids].sum(0, dtype=np.float64) / n[i]
        return out, n


def _score(batches: Iterator[pa.RecordBatch], models: Models) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(models)
    names = np.array([*models.languages, UNKNOWN], object)
    for batch in batches:
        mean, n = scorer(batch.column(1).to_pylist())
        best = mean.argmax(axis=1)
        at = np.arange(len(best))
        entropy = -mean[at, best]
        sure = 1 / np.exp((mean - mean[at, best][:, None]) * n[:, None]).sum(axis=1)
        reject = n == 0
        if models.limit is not None:
            above = entropy - models.mean[best]
            far = above > FLOOR * (np.log(models.alphabet) - models.mean[best])
            reject |= far & (above * np.sqrt(np.minimum(n, LONG)) > models.limit[best])
        named = np.where(n > 0, best, len(models.languages))
        columns = [batch.column(0), pa.array(names[named], pa.string()), pa.array(np.where(n > 0, sure, 0.0)), pa.array(np.where(n > 0, entropy, 0.0)), pa.array(n), pa.array(reject)]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "lang_pred", "score", "entropy", "symbols", "rejected"])


def score(df: DataFrame, models: Models, key: str, text: str = "text") -> DataFrame:
    """``key, lang_pred, score, entropy, symbols, rejected`` for every row."""
    shared = df.sparkSession.sparkContext.broadcast(models)  # bounded by the training sample
    kind = df.schema[key].dataType.simpleString()
    return map_arrow(df.select(key, text), lambda b: _score(b, shared.value), f"key {kind}, lang_pred string, score double, entropy double, symbols bigint, rejected boolean")


def train(labelled: DataFrame) -> Models | None:
    """Models from the rows of ``labelled`` (``doc_id, text, lang``) with a label; None if there are none."""
    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", F.xxhash64(F.col("doc_id").cast("string"), F.length("text")).alias("h"))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("size")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    found = {r.lang: (r.n, r["size"]) for r in sizes.collect()}
    if not found:
        return None
    each, size = min(DOCS_PER_LANGUAGE, DOCS // len(found)) or 1, CODE_POINTS / len(found)
    # each language keeps the hashes below its share of the range
    share = F.create_map(*chain.from_iterable((F.lit(k), F.lit(min(1.0, each / n, size / max(1, z)))) for k, (n, z) in sorted(found.items())))
    unit = F.pmod("h", F.lit(1 << 20)) / float(1 << 20)
    sample = rows.filter(unit < share[F.col("lang")]).withColumn("half", F.shiftright("h", 20) % 2 == 0)
    counted = map_arrow(sample.filter("half").select("lang", "text"), _count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = {}
    for batch in counted.toArrow().to_batches():  # bounded by the sample
        for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            counts.setdefault(lang, {})[word] = n
    counts = {k: v for k, v in counts.items() if any(RUN.search(w) for w in v)}
    if not counts:  # too few rows to halve
        for r in sample.collect():
            counts.setdefault(r.lang, Counter()).update(_words(r.text))
        counts = {k: v for k, v in counts.items() if any(RUN.search(w) for w in v)}
    if not counts:
        return None
    models = fit(counts)
    held = score(sample.filter("NOT half"), models, "lang").filter("symbols > 0 AND key = lang_pred").select("key", "entropy", "symbols").collect()
    mean, limit = np.full(len(models.languages), np.inf), np.full(len(models.languages), np.inf)
    for i, name in enumerate(models.languages):
        own = [(r.entropy, min(r.symbols, LONG)) for r in held if r.key == name]
        if len(own) >= 20:  # else nothing of this language is rejected
            h, n = np.array(own).T
            mean[i] = np.average(h, weights=n)
            limit[i] = MARGIN * ((h - mean[i]) * np.sqrt(n)).max()
        else:
            mean[i] = 0.0
    models.mean, models.limit = mean, limit
    return models


def identify(docs: DataFrame, labelled: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key`` and what :func:`score` says of every row of ``docs``, by models of ``labelled``."""
    models = train(labelled)
    if models is None:
        none = (F.lit(UNKNOWN), F.lit(0.0), F.lit(0.0), F.lit(0).cast("long"), F.lit(True))
        return docs.select(F.col(key).alias("key"), *(c.alias(n) for c, n in zip(none, ("lang_pred", "score", "entropy", "symbols", "rejected"))))
    return score(docs, models, key)


def part(key: Column, parts: int) -> Column:
    """Which of so many parts a document is in, by the CRC-32 of its id as text."""
    return F.crc32(key.cast("string").cast("binary")) % parts


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is not rejected, by models of all of its labelled rows."""
    models = train(docs)
    if models is None:
        return docs.limit(0)
    packed = docs.select(F.struct("*").alias("key"), "text")
    return score(packed, models, "key").filter("NOT rejected").select("key.*")


def op2_identify_language(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = docs.filter(part(F.col("doc_id"), 4) != 2)
    found = identify(docs, learned)
    return found.select(F.col("key").alias("doc_id"), F.coalesce(part(F.col("key"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "entropy", "rejected")
