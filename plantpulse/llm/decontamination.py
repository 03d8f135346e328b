"""Benchmark decontamination by winnowing.

Of every run of words, ``K``-word hashes are taken and in each window of ``WINDOW - K + 1`` of them the
smallest is kept, for documents and benchmark alike. A shared run of ``WINDOW`` words holds one such
window whole, both sides keep the same minimum, so each shared run of that length meets in a
fingerprint. A meeting is then extended over the whole item: equal runs of ``WINDOW`` words or
more are hits. Items of fewer words are one window: all runs of their length are compared.

The benchmark's fingerprints are sent to the tasks in chunks of at most about ``CHUNK_WORDS`` words, so
memory is bounded for a benchmark of any size; documents are never shuffled, and one chunk (the usual
case) is one pass. With more, what was found so far is staged between passes.

Defined results: null and empty texts have no words and no hits; null or empty items are in no
document; a null item_id counts as the empty string; equal item_ids count once; repeated rows are
judged one by one; an empty benchmark hits nothing; the input's columns stay in ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantpulse.llm import text_hash as th
from plantpulse.llm.mapping import beside
from plantpulse.llm.staging import staged

WINDOW, K = 10, 5
CHUNK_WORDS = 1_000_000
_ITEMS, _HITS = "array<string>", "array<struct<first:bigint,count:bigint>>"


def winnowed(hashes: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the k-word runs that are smallest in a window of window - k + 1 runs."""
    grams, w = th.runs(hashes, k), window - k + 1
    if len(grams) < w:
        return np.empty(0, np.int64), grams[:0]
    lowest = _extreme(grams, w, np.minimum)
    edge = np.zeros(w - 1, np.uint64)
    chosen = np.flatnonzero(_extreme(np.concatenate([edge, lowest, edge]), w, np.maximum) == grams)
    return chosen, grams[chosen]


def _extreme(x: np.ndarray, w: int, f: np.ufunc) -> np.ndarray:
    """Smallest or largest of each w neighbours, by doubling."""
    n, length, out = len(x) - w + 1, 1, x
    while 2 * length <= w:
        out = f(out[:-length], out[length:])
        length *= 2
    return f(out[:n], out[w - length:]) if length < w else out


@dataclass(frozen=True)
class BenchmarkIndex:
    """Items' words, and by fingerprint where in which item it stands; plain arrays, sent to every task."""

    ids: list[str]
    words: list[np.ndarray]
    tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]  # (window, k): hash, item, place


def index_of(ids: list[str], texts: pa.Array, window: int, k: int) -> BenchmarkIndex:
    words = [w.hashes[a:b] for w in th.slices(texts, th.ALPHANUMERIC) for a, b in zip(w.bounds[:-1], w.bounds[1:])]
    found: dict[tuple[int, int], list] = {}
    for item, hashes in enumerate(words):
        n = len(hashes)
        if n:
            kind = (window, k) if n >= window else (n, n)
            place, prints = winnowed(hashes, *kind)
            found.setdefault(kind, []).append((prints, np.full(len(place), item), place))
    tables = {}
    for kind, parts in found.items():
        prints, items, places = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(prints, kind="stable")
        tables[kind] = prints[order], items[order], places[order]
    return BenchmarkIndex(ids, words, tables)


def _meetings(hashes: np.ndarray, index: BenchmarkIndex) -> np.ndarray:
    """(item, shift) pairs, each once: item word j may equal word shift + j."""
    pairs = []
    for (window, k), (prints, items, places) in index.tables.items():
        at, got = winnowed(hashes, window, k)
        lo = np.searchsorted(prints, got)
        met = prints[np.minimum(lo, len(prints) - 1)] == got
        at, got, lo = at[met], got[met], lo[met]
        many = np.searchsorted(prints, got, side="right") - lo
        entry = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        pairs.append(np.stack([items[entry], np.repeat(at, many) - places[entry]], axis=1))
    return np.unique(np.concatenate(pairs), axis=0) if pairs else np.empty((0, 2), np.int64)


def _equal_runs(same: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
    for a, b in zip(edges[::2], edges[1::2]):
        if b - a >= least:
            yield a, b


def _hits(words: th.Words, index: BenchmarkIndex, window: int) -> tuple[np.ndarray, list[set[int]]]:
    """Which words are hit, and the items of each text."""
    hit, items = np.zeros(len(words.hashes), bool), [set() for _ in range(words.n_docs)]
    bounds = words.bounds
    for item, shift in _meetings(words.hashes, index):
        inside = index.words[item]
        # an item may reach over a text's end and still share a whole window with it
        first, last = np.searchsorted(bounds, [max(shift, 0), min(shift + len(inside), len(hit)) - 1], side="right") - 1
        for doc in range(first, last + 1):
            lo, hi = max(shift, bounds[doc]), min(shift + len(inside), bounds[doc + 1])
            same = words.hashes[lo:hi] == inside[lo - shift:hi - shift]
            for a, b in _equal_runs(same, min(window, len(inside))):
                hit[lo + a:lo + b] = True
                items[doc].add(int(item))
    return hit, items


def decontaminate(docs: DataFrame, benchmark: DataFrame, carry: list[str] | None = None, window: int = WINDOW, k: int = K,
                  chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """``row``, n_words, items (sorted ids of items with a window in the text), hits (ranges of hit words)."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), "text").distinct()  # equal rows would share a chunk
    n_words = items.agg(F.coalesce(F.sum(F.size(F.split("text", "[^0-9A-Za-z\\u0080-\\uFFFF]+"))), F.lit(0))).first()[0]
    chunks = max(1, -(-2 * n_words // chunk_words))
    carried = docs.columns if carry is None else carry
    found = docs.select(F.struct(*(F.col(f"`{c}`") for c in carried)).alias("doc"), "text",
                        F.lit(None).cast(_ITEMS).alias("items"), F.lit(None).cast(_HITS).alias("hits"))
    for chunk in range(chunks):
        mine = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(chunks)) == chunk) if chunks > 1 else items
        table = mine.toArrow()  # bounded: about half of chunk_words
        index = spark.sparkContext.broadcast(index_of(table["id"].to_pylist(), _one(table["text"]), window, k))
        last = chunk + 1 == chunks
        marked = beside(found, lambda index=index: _marker(index.value, window), f"n_words bigint, items {_ITEMS}, hits {_HITS}",
                        ["doc", "items", "hits", *([] if last else ["text"])])
        found = marked.select(
            F.col("row.doc").alias("doc"), "n_words", *([] if last else [F.col("row.text").alias("text")]),
            *(F.array_sort(F.array_union(F.coalesce(f"row.{c}", c), c)).alias(c) for c in ("items", "hits")))
        found = found if last else staged(found, "hits")
    return found.select(F.col("doc").alias("row"), "n_words", "items", "hits")


def _one(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays([pa.array([], pa.large_string()), *column.cast(pa.large_string()).chunks])


def _marker(index: BenchmarkIndex, window: int):
    def mark(texts: pa.Array) -> list[pa.Array]:
        counts, ids, ranges = [], [], []
        for words in th.slices(texts, th.ALPHANUMERIC):
            hit, items = _hits(words, index, window)
            counts.append(words.counts)
            for doc, (a, b) in enumerate(zip(words.bounds[:-1], words.bounds[1:])):
                ids.append(sorted({index.ids[i] for i in items[doc]}))
                ranges.append([{"first": int(x), "count": int(y - x)} for x, y in _equal_runs(hit[a:b], 1)] if ids[-1] else [])
        kind = pa.list_(pa.struct([("first", pa.int64()), ("count", pa.int64())]))
        return [pa.array(np.concatenate(counts) if counts else [], pa.int64()), pa.array(ids, pa.list_(pa.string())),
                pa.array(ranges, kind)]
    return mark


def n_hit(hits: str = "hits") -> Column:
    """Number of words in the (possibly overlapping) ranges."""
    end = "(r.first + r.count)"
    return F.expr(f"aggregate(array_sort({hits}), named_struct('n', 0L, 'at', 0L), (s, r) -> named_struct("
                  f"'n', s.n + greatest(0L, {end} - greatest(s.at, r.first)), 'at', greatest(s.at, {end})), s -> s.n)")
