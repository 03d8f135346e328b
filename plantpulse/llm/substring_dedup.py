"""Substring deduplication by level-wise doubling of repeated windows.

The lengths double up to the wanted window (18, 35 words). At the first length only minimizers are
counted: of the 18-word runs inside each 35-word window the one with the smallest hash. Equal windows
choose equal runs, so a window can only repeat if its run does, and about one run in ten is
shuffled. Windows whose chosen run repeats, alone, are extended to the next length and counted there;
from then on both halves of a longer window must repeat. The doubling ends at the wanted length, or
earlier when a level leaves no candidate.

Equal texts are one row from the start (key: MD5 of the text); all windows of a text with copies
repeat, so it needs no window of its own to decide, but still counts once for other texts. Each
(hash, text) pair is one row however often it repeats in the text, hashes are counted by partial sums
before any shuffle, and the rows of a hash shared by very many texts meet the list of repeated
hashes in a join whose large side Spark can split. Distinct texts are kept in a table bucketed by
key, so that later passes move the candidates to the texts and not the texts.

Words are compared by 64-bit hashes of runs at two lengths, both of which must repeat.

Defined results: null counts as empty; texts shorter than the window lose nothing; an empty table gives
an empty result; repeated rows are copies of each other and lose all words when long enough; other
columns pass through unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantpulse.llm import text_hash as th
from plantpulse.llm.staging import bucketed, own_name

WINDOW = 35


def lengths(window: int) -> list[int]:
    """Doubling lengths that end at the window: 35 -> 18, 35; 100 -> 25, 50, 100."""
    if window < 2:
        raise ValueError("a window has two words at least")
    out = [window]
    while out[0] > 35 or len(out) == 1 and out[0] > 1:
        out.insert(0, -(-out[0] // 2))
    return out


def text_key(text: str = "text") -> Column:
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(key, text, copies), one row for each different text, bucketed by key."""
    texts = (docs.select(text_key().alias("key"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
             .groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies")))
    return bucketed(texts, "key", "texts")


def _chosen(words: th.Words, first: int, then: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts of windows of ``then`` words, hash of the smallest run of ``first`` words in each)."""
    starts = th.window_starts(words, then)
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    grams, w = th.runs(words.hashes, first), then - first + 1
    length, low = 1, grams
    while 2 * length <= w:
        low = np.minimum(low[:-length], low[length:])
        length *= 2
    low = np.minimum(low[:len(grams) - w + 1], low[w - length:]) if length < w else low
    return starts, low[starts]


def _runs_by_level(words: th.Words, levels: list[int], known: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(candidate starts, their hashes) at level len(known), given the repeated hashes of earlier levels.

    ``known[j]`` holds, for one text, the sorted hashes that repeat at level j.
    """
    first, then = levels[0], levels[1]
    starts, low = _chosen(words, first, then)
    if not known:
        return starts, low
    keep = np.isin(low, known[0])
    starts = starts[keep]
    hashes = th.runs(words.hashes, then)
    for level in range(2, len(known) + 1):
        size, longer = levels[level - 1], levels[level]
        repeated = np.zeros(len(words.hashes) + longer, bool)
        repeated[starts[np.isin(hashes[starts], known[level - 1])]] = True
        fits = th.window_starts(words, longer)
        starts = fits[repeated[fits] & repeated[fits + longer - size]]
        hashes = th.runs(words.hashes, longer)
    return starts, hashes[starts] if len(starts) else np.empty(0, np.uint64)


def _emit(levels: list[int], depth: int):
    """Rows (hash, key, n): the candidate windows of each text at a level, each hash once a text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for words, doc, known in _texts(batch, depth):
                if depth:
                    parts = [(d, _runs_by_level(w, levels, k)[1]) for w, d, k in zip(words, doc, known)]
                else:  # all texts of a slice at once
                    starts, low = _chosen(words, levels[0], levels[1])
                    parts = [(doc[words.doc_of[starts]], low)]
                ids = np.concatenate([np.broadcast_to(d, len(h)) if np.ndim(d) == 0 else d for d, h in parts])
                hashes = np.concatenate([h for _, h in parts])
                if not len(hashes):
                    continue
                if depth:
                    order = np.lexsort((hashes, ids))
                    ids, hashes = ids[order], hashes[order]
                    new = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1])]))
                    n = np.diff(np.append(new, len(ids)))
                    ids, hashes = ids[new], hashes[new]
                else:
                    ids, hashes, n = _distinct_runs(ids, hashes, words, starts, levels)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64)), keys.take(pa.array(ids)), pa.array(n, pa.int32())], names=["h", "key", "n"])
    return run


def _distinct_runs(ids, hashes, words, starts, levels):
    """Of the minimizers of neighbouring windows: each run of words once, then each hash once a text."""
    grams, w = th.runs(words.hashes, levels[0]), levels[1] - levels[0] + 1
    edge = np.zeros(w - 1, np.uint64)
    full = np.zeros(max(len(grams) - w + 1, 0), np.uint64)  # 0 where no whole window starts
    full[starts] = hashes
    padded = np.concatenate([edge, full, edge])
    length, high = 1, padded
    while 2 * length <= w:
        high = np.maximum(high[:-length], high[length:])
        length *= 2
    high = np.maximum(high[:len(grams)], high[w - length:]) if length < w else high
    at = np.flatnonzero(high == grams)
    ids = ids[0] - words.doc_of[starts[0]] + words.doc_of[at]  # texts of a slice follow each other
    hashes = grams[at]
    order = np.lexsort((hashes, ids))
    ids, hashes = ids[order], hashes[order]
    new = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1])]))
    return ids[new], hashes[new], np.diff(np.append(new, len(ids)))


def _texts(batch: pa.RecordBatch, depth: int):
    """Slices of texts; with known hashes, text by text."""
    for words in th.slices(batch.column(1), th.PLAIN):
        if not depth:
            yield words, np.arange(words.first, words.first + words.n_docs), None
            continue
        bounds, own, doc, known = words.bounds, [], [], []
        columns = [batch.column(2 + j).slice(words.first, words.n_docs) for j in range(depth)]
        for d in range(words.n_docs):
            lists = [c[d].values for c in columns]
            if all(x is not None and len(x) for x in lists):
                own.append(th.Words(0, words.counts[d:d + 1], words.hashes[bounds[d]:bounds[d + 1]]))
                doc.append(words.first + d)
                known.append([np.sort(x.to_numpy().view(np.uint64)) for x in lists])
        if own:
            yield own, doc, known


def _repeated(rows: DataFrame, level: int) -> DataFrame:
    """(key, h<level>): by text, the hashes of its windows that start somewhere else too."""
    again = rows.groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h")
    return rows.join(again, "h").groupBy("key").agg(F.collect_set("h").alias(f"h{level}"))


def repeated_windows(texts: DataFrame, window: int = WINDOW) -> tuple[DataFrame, list[str]]:
    """Texts with, for each level, the hashes of their repeated windows; and the names of those columns."""
    levels, found, names = lengths(window), texts, []
    for depth in range(len(levels)):
        source = found.select("key", "text", *names)
        for name in names:
            source = source.filter(F.col(name).isNotNull())
        rows = source.mapInArrow(_emit(levels, depth), "h long, key string, n int")
        found = found.join(_repeated(rows, depth), "key", "left")
        names.append(f"h{depth}")
    return found, names


def _remover(window: int):
    levels = lengths(window)

    def remove(texts: pa.Array, copies: pa.Array, columns: list[pa.Array]) -> list[pa.Array]:
        total, gone, kept = [], [], []
        raw = texts.to_pylist()
        for words in th.slices(texts, th.PLAIN):
            bounds = words.bounds
            for d in range(words.n_docs):
                at, n = words.first + d, int(words.counts[d])
                own = th.Words(0, words.counts[d:d + 1], words.hashes[bounds[d]:bounds[d + 1]])
                removed = np.zeros(n, bool)
                lists = [c[at].values for c in columns]
                if copies[at].as_py() > 1 and n >= window:
                    removed[:] = True
                elif n >= window and all(x is not None and len(x) for x in lists):
                    known = [np.sort(x.to_numpy().view(np.uint64)) for x in lists]
                    starts, hashes = _runs_by_level(own, levels, known[:-1])
                    edge = np.zeros(n + 1, np.int64)
                    starts = starts[np.isin(hashes, known[-1])]
                    edge[starts] += 1
                    edge[starts + window] -= 1
                    removed = np.cumsum(edge[:-1]) > 0
                split = (raw[at] or "").encode().split()
                total.append(n)
                gone.append(int(removed.sum()))
                kept.append(b" ".join(w for w, r in zip(split, removed) if not r) if gone[-1] else b" ".join(split))
        return [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
    return remove


def removals(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """For each different text: key, n_words, n_removed, kept_text (its other words joined by a space)."""
    found, names = repeated_windows(distinct_texts(docs), window)
    remove = _remover(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *remove(batch.column(1), batch.column(2), batch.columns[3:])],
                names=["key", "n_words", "n_removed", "kept_text"])

    return found.select("key", "text", "copies", *names).mapInArrow(
        run, "key string, n_words long, n_removed long, kept_text string")


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with the repeated words taken out of ``text``; documents that lose nothing stay as they are."""
    key, kept, gone = (own_name(docs, x) for x in ("text_key", "kept_text", "n_removed"))
    found = removals(docs, window).select(F.col("key").alias(key), F.col("n_removed").alias(gone), F.col("kept_text").alias(kept))
    changed = found.filter(F.col(gone) > 0)
    joined = docs.withColumn(key, text_key()).join(changed, key, "left")
    return joined.select(*(F.when(F.col(gone) > 0, F.col(kept)).otherwise(F.col("text")).alias(c) if c == "text" else F.col(f"`{c}`")
                           for c in docs.columns))
