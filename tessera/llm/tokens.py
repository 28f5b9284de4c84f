"""Token ids of texts by a public tokenizer file, with a bounded cache of words."""

from __future__ import annotations

import sys
from array import array
from codecs import charmap_decode
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from tessera.llm.common import give_back

#: Words that a process remembers, the latest first, and pieces of words: a generation, and the one before.
CACHE = 400_000
PIECES = 100_000
#: Words whose ids are put in place at once.
PLACED = 1 << 18
#: The tokenizer's own way of cutting lower-cased text; fixed value.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Characters that are one piece after a word's letters, however many.
MARKS = "!\"#$%&'()*+,-./:;=?@[\\]^_`{|}~"
#: Words of these characters only are cut here; all others go through the whole tokenizer.
PLAIN = regex.compile(r"[\x21-\x3b\x3d\x3f-\x7e\xa1-\xac\xae-\xff]+")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it is printable, else the next code point from 256."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return {b: chr(b) if b in printable else chr(next(others)) for b in range(256)}


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def latin(word: str) -> bool:
    """Whether no character lies beyond U+00FF."""
    try:
        word.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of spans one after another."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 1 << 31 and not (len(first) and int(first.max()) >= 1 << 31) else np.int64
    out = np.repeat((first - ends + size).astype(kind), size)
    out += np.arange(total, dtype=kind)
    return out


class Recent(dict):
    """The last PIECES entries or more, twice as many at most: what is asked for again moves to the newer half."""

    def __init__(self):
        self.older: dict[str, bytes] = {}

    def recall(self, key: str) -> bytes | None:
        found = self.older.get(key)
        if found is not None:
            self[key] = found
        return found

    def trim(self) -> None:
        if len(self) >= PIECES:
            self.older = dict(self)
            self.clear()


class WordTokens:
    """Little-endian 32-bit ids of words without ASCII white space, as bytes.

    Only for tokenizers that cut at white space and lower-case their input, as
    word_bpe_49k does: the ids of a text are then those of its words in a row.
    Texts are cut at ASCII white space; a word that holds other white space, or
    anything unusual, goes through the tokenizer itself, which cuts it further.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = "".join(letter for _, letter in sorted(byte_letters().items()))
        self.tokenize = self.tokenizer.model.tokenize
        self.packed = [_packed([i]) for i in range(1 + max(self.tokenizer.get_vocab().values()))]
        self.pieces = Recent()
        # remembered words, and their ids one after another
        self.words, self.ids_of = pa.array([], pa.large_string()), np.zeros(0, "<u4")
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            found = self.pieces.recall(piece)
        if found is None:
            mapped = piece if piece.isascii() else charmap_decode(piece.encode(), "strict", self.letters)[0]
            known = self.packed
            self.pieces[piece] = found = b"".join([known[t.id] for t in self.tokenize(mapped)])
        return found

    def _word(self, word: str) -> bytes:
        """Ids of a word whose ASCII letters are small."""
        body = word.rstrip(MARKS)
        if body.isalpha() and (body.isascii() or latin(body)):
            found = self.pieces.get(body) or self._piece(body if body.isascii() else body.lower())
            return found + self._piece(word[len(body) :]) if len(body) < len(word) else found
        if PLAIN.fullmatch(word):
            return b"".join(map(self._piece, PIECE.findall(word.lower())))
        return _packed(self.tokenizer.encode(word, add_special_tokens=False).ids) if word else b""

    def _look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where those of each of these different words start and how many they are."""
        few = 16 * len(words) < len(self.words)  # cutting a few words again takes less than a table of all remembered ones
        at = pc.index_in(words, value_set=self.words[:0] if few else self.words)
        new = pc.is_null(at)
        found = list(map(self._word, words.filter(new).to_pylist()))
        self.pieces.trim()
        new = new.to_numpy(zero_copy_only=False)
        at = at.fill_null(0).to_numpy()
        ids = np.concatenate([self.ids_of, np.frombuffer(b"".join(found), "<u4")])
        first, size = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        first[~new], size[~new] = self.first[at[~new]], self.size[at[~new]]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        first[new], size[new] = len(self.ids_of) + np.cumsum(sizes) - sizes, sizes
        if 16 * len(found) > len(self.words):
            self._remember(words, ids, first, size, at[~new])
        return ids, first, size

    def _remember(self, words: pa.Array, ids: np.ndarray, first: np.ndarray, size: np.ndarray, again: np.ndarray) -> None:
        """These words, and those asked for before them, as far as they fit; what is left out is only cut again."""
        older = np.ones(len(self.words), bool)
        older[again] = False
        kept = pa.concat_arrays([words, self.words.filter(pa.array(older))])[:CACHE]
        first, size = (np.concatenate([x, y[older]])[:CACHE] for x, y in ((first, self.first), (size, self.size)))
        self.words = pa.concat_arrays([kept])
        self.ids_of = ids[_spans(first, size)]
        self.first, self.size = np.cumsum(size) - size, size

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (null: none), and where each text starts in them, with the end last. Each different word is looked up once."""
        cut = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        coded = cut.flatten().dictionary_encode()
        offsets = cut.offsets.to_numpy()
        del cut  # as large as all words; what follows needs room
        # the words are made small, not the texts: ascii_lower reads slices of large strings at the wrong place
        small = pc.ascii_lower(coded.dictionary).dictionary_encode()
        code, different = small.indices.to_numpy()[coded.indices.to_numpy()], small.dictionary
        del coded, small
        ids, first, size = self._look_up(different)
        del different
        start = np.append(0, np.cumsum(size[code]))[offsets - offsets[0]]
        out = np.empty(start[-1], "<u4")
        done = 0
        for i in range(0, len(code), PLACED):
            some = code[i : i + PLACED]
            at = _spans(first[some], size[some])
            out[done : done + len(at)] = ids[at]
            done += len(at)
        return out, start

    def ids(self, text: str | None) -> np.ndarray:
        return self.of(pa.array([text], pa.string()))[0]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokens:
    return WordTokens(path)


def forget() -> None:
    """Drops this process's tokenizers and the words that they remember, which steps after the tokenising have no use for."""
    if tokenizer.cache_info().currsize:
        tokenizer.cache_clear()
        give_back()
