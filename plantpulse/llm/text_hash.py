"""Words of whole texts as 64-bit hashes, computed in bulk on Arrow's own buffers.

No Python object is made per word: a byte class table finds the words, a segmented sum of
``table[byte] * base**position`` hashes them, and runs of words are hashed by doubling. Work is done in
slices of a few megabytes, cut between texts, so temporary arrays stay bounded; one text longer
than a slice is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2_000_000

_U = np.uint64
_BASE, _A, _B, _C = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64 output bits (one to one)."""
    x = x ^ (x >> _U(32))
    x *= _A
    x ^= x >> _U(29)
    x *= _B
    x ^= x >> _U(32)
    return x


def combine(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(left * _BASE + ((right << _U(31)) | (right >> _U(33))) * _C)


@dataclass(frozen=True)
class Alphabet:
    """Which bytes belong to words, and what each byte counts as."""

    is_word: np.ndarray
    value: np.ndarray


def alphabet(word_bytes: set[int], lower: bool) -> Alphabet:
    fold = np.arange(256)
    if lower:
        fold[ord("A"):ord("Z") + 1] += 32
    member = np.zeros(256, dtype=bool)
    member[sorted(word_bytes)] = True
    return Alphabet(member, mix((np.arange(1, 257, dtype=np.uint64) * _C)[fold]))


_SPACE = {0x20, *range(0x09, 0x0E)}
#: ``[^\x20\x09-\x0D]+``, unchanged and with A-Z lowered.
PLAIN, LOWERED = (alphabet(set(range(256)) - _SPACE, lower) for lower in (False, True))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lowering A-Z: digits, letters and all that is not ASCII.
ALPHANUMERIC = alphabet({*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}, True)

_powers = np.ones(1, dtype=np.uint64)


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 1024)
        _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _BASE, np.uint64)]), dtype=np.uint64)
    return _powers


@dataclass(frozen=True)
class Words:
    """The words of texts ``first`` .. ``first + n_docs - 1`` of a batch, in order."""

    first: int
    counts: np.ndarray  # words of each text
    hashes: np.ndarray  # one per word
    start: np.ndarray | None = None  # first byte of each word
    length: np.ndarray | None = None  # bytes of each word

    @property
    def n_docs(self) -> int:
        return len(self.counts)

    @property
    def bounds(self) -> np.ndarray:
        """Text d has words bounds[d] .. bounds[d + 1] - 1."""
        return np.concatenate([[0], np.cumsum(self.counts)])

    @property
    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.counts)


def words_of(data: np.ndarray, cuts: np.ndarray, kind: Alphabet, first: int = 0) -> Words:
    """Words of the texts data[cuts[d]:cuts[d + 1]]; a word never runs from one text into the next."""
    inside = kind.is_word[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    filled = cuts[:-1] < cuts[1:]
    heads, tails = cuts[:-1][filled], cuts[1:][filled] - 1
    opens[heads] = inside[heads]
    closes[tails] = inside[tails]
    start = np.flatnonzero(opens)
    length = np.flatnonzero(closes) + 1 - start
    counts = np.diff(np.searchsorted(start, cuts))
    if not len(start):
        return Words(first, counts, np.empty(0, np.uint64), start, length)
    offset = np.cumsum(length) - length
    place = np.arange(int(length.sum()), dtype=np.int64) - np.repeat(offset, length)
    terms = kind.value[data[inside]]
    terms *= _powers_to(int(length.max()))[place]
    return Words(first, counts, mix(np.add.reduceat(terms, offset) + length.astype(np.uint64)), start, length)


def slices(texts: pa.Array, kind: Alphabet, slice_bytes: int = SLICE_BYTES) -> Iterator[Words]:
    """Words of every text of a column (null: none), a bounded slice of texts at a time."""
    for first, data, cuts in text_slices(texts, slice_bytes):
        yield words_of(data, cuts, kind, first)


def text_slices(texts: pa.Array, slice_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, bytes, cuts) of runs of texts; null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    cuts = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(cuts, cuts[lo] + slice_bytes, side="right")) - 1)
        yield lo, raw[cuts[lo]:cuts[hi]], cuts[lo:hi + 1] - cuts[lo]
        lo = hi


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on (len(hashes) - n + 1 of them), ignoring text bounds."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    out, length = mix(hashes + _U(n)), 1
    while 2 * length <= n:
        out = combine(out[:-length], out[length:])
        length *= 2
    return combine(out[:len(hashes) - n + 1], out[n - length:]) if length < n else out


def window_starts(words: Words, n: int) -> np.ndarray:
    """Positions from which n words of one text follow."""
    if len(words.hashes) < n:
        return np.empty(0, np.int64)
    end = np.repeat(words.bounds[1:], words.counts)
    place = np.arange(len(words.hashes))
    return place[place + n <= end]
