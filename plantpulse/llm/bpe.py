"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a piece exactly one vocabulary token can end its encoding. An automaton over the
vocabulary reports, at each character, all tokens that are a suffix of what was read; the one that is
compatible with the token stored where it begins is the prefix's last token. Two tokens are
compatible when BPE leaves their boundary alone, which is seen by undoing merges on both sides, latest
first. From the end, the stored tokens are the back-pointers that give the exact ids. Work per
piece is linear in its length for bounded token lengths; pieces are remembered in a bounded cache.

Text is prepared as the vocabulary file says: NFC, white space, lower case without the rule for a
final sigma, then pieces of letters, single digits and runs of other characters. The special strings
of the file are taken out first and become their ids.

Defined results: null and empty texts have no tokens; repeated rows are encoded one by one; an empty table
gives no rows; the input's columns stay in ``row``.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from plantpulse.llm.mapping import beside

VOCABULARY = "word_bpe_49k.json"
CACHED_PIECES = 200_000

# The piece pattern of the vocabulary file, and the mark that its tokens carry at a piece's end.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
END = "</w>"
_LAST = 0xE000  # added to a character that ends a piece: "e</w>" is one symbol


def _byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


def _symbols(token: str) -> str:
    if token.endswith(END) and len(token) > len(END):
        token = token[:-len(END)]
        return token[:-1] + chr(_LAST + ord(token[-1]))
    return token


class BpeCodec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocabulary: dict[str, int] = file["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.tokens = {i: t for t, i in [*vocabulary.items(), *self.special.items()]}
        self.rank, self.parts, self.pair = {}, {}, {}
        for rank, (a, b) in enumerate(file["model"]["merges"]):
            left, right, made = vocabulary[a], vocabulary[b], vocabulary[a + b]
            self.pair.setdefault((left, right), (rank, made))
            if made not in self.rank:
                self.rank[made], self.parts[made] = rank, (left, right)
        self.automaton = ahocorasick.Automaton()
        for token, i in vocabulary.items():
            symbols = _symbols(token)
            if len(symbols) == 1 or i in self.rank:
                self.automaton.add_word(symbols, (len(symbols), i))
        self.automaton.make_automaton()
        self.bytes = dict(enumerate(_byte_characters()))
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self._compatible: dict[tuple[int, int], bool] = {}
        self._recent: dict[str, tuple[int, ...]] = {}
        self._older: dict[str, tuple[int, ...]] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE of the two tokens' text is just these two."""
        key = (left, right)
        known = self._compatible.get(key)
        if known is None:
            if len(self._compatible) > 1_000_000:
                self._compatible.clear()
            known = self._compatible[key] = self._holds(left, right)
        return known

    def _holds(self, left: int, right: int) -> bool:
        rank, before = self.rank, float("inf")
        while True:
            merge = self.pair.get((left, right))
            if merge is not None and merge[0] < before:
                return False  # the inner neighbours would have merged first
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                before, left = a, self.parts[left][1]
            else:  # of equal merges the one further left comes first
                before, right = b + 1, self.parts[right][0]

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        symbols = piece.encode("utf-8").decode("latin-1").translate(self.bytes)
        symbols = symbols[:-1] + chr(_LAST + ord(symbols[-1]))
        last, compatible = [-1] * (len(symbols) + 1), self.compatible
        sizes = [0] * (len(symbols) + 1)
        for end, (size, token) in self.automaton.iter(symbols):
            end += 1
            if last[end] < 0:
                before = last[end - size]
                if end == size or before >= 0 and compatible(before, token):
                    last[end], sizes[end] = token, size
        ids, at = [], len(symbols)
        while at:
            ids.append(last[at])
            at -= sizes[at]
        return tuple(ids[::-1])

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        if not text:
            return ids
        parts = self.split.split(text) if self.split and "<|" in text else [text]
        recent, older = self._recent, self._older
        for part in parts:
            if part in self.special:
                ids.append(self.special[part])
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            for piece in PIECES.findall(part.lower()):
                found = recent.get(piece)
                if found is None:
                    found = older.get(piece) or self.encode_piece(piece)
                    if len(piece) < 64:
                        recent[piece] = found
                        if len(recent) > CACHED_PIECES:
                            older, recent = recent, {}
                            self._recent, self._older = recent, older
                ids += found
        return ids

    def decode(self, ids) -> str:
        """The tokens as they are, joined by a space: the file names no decoder."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids])


@lru_cache(maxsize=2)
def codec(path: str) -> BpeCodec:
    """One codec and cache for each worker process."""
    return BpeCodec(path)


def vocabulary_path(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)


def bpe_encode(docs: DataFrame, path: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """``row`` and ids (array<int>)."""
    def make():
        own = codec(path or vocabulary_path())
        return lambda texts: [_lists([own.encode(t) for t in texts.to_pylist()])]
    return beside(docs, make, "ids array<int>", carry)


def bpe_decode(encoded: DataFrame, path: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """``row`` and text: what the vocabulary makes of a column ``ids``."""
    def make():
        own = codec(path or vocabulary_path())
        return lambda lists: [pa.array([None if x is None else own.decode(x) for x in lists.to_pylist()], pa.string())]
    return beside(encoded, make, "text string", carry, text="ids")


def bpe_round_trip(docs: DataFrame, path: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """``row``, ids and decoded (what decoding the ids gives), in one pass."""
    def make():
        own = codec(path or vocabulary_path())

        def both(texts: pa.Array) -> list[pa.Array]:
            lists = [own.encode(t) for t in texts.to_pylist()]
            return [_lists(lists), pa.array([own.decode(x) for x in lists], pa.string())]
        return both
    return beside(docs, make, "ids array<int>, decoded string", carry)


def _lists(lists: list[list[int]]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
    values = np.concatenate([np.array(x, np.int32) for x in lists]) if lists else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
