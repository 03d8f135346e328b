"""Phrase collocations by sorting suffix pointers, for each language apart.

A suffix is a word and up to three that follow it in its piece of text. Words that are too rare, then pairs of neighbouring
words that are too rare, are counted first and leave two bitmaps; a suffix ends where its next pair is rare, and those
without a frequent pair are abandoned before anything is moved. The others are routed by their two leading words to a
task, which sorts them by multikey three-way quicksort to the full depth: the size of each equal partition is a phrase's
count, and a partition of less than ``LEAST`` is abandoned unsorted. Equal suffixes of a batch travel as one with a
number. Leading pairs with more than a partition's fair share of all suffixes (fewer than there are partitions) are
routed by the whole suffix; the parts of their counts are added up afterwards.

All segments of a task are partitioned at once, each around the median of three keys, so a round of the
quicksort is a few passes over arrays. Words are 64-bit hashes of language and word; strings are looked up for the
ranked phrases only. Bitmaps have at most 2**28 bits: where they fill up more suffixes travel, no count changes.

Defined results: null texts count as empty, null languages as ``und``; overlapping occurrences all count; repeated rows count each; texts
without words add nothing; an empty table gives no rows; columns other than text and lang don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantpulse.llm import text_hash as th
from plantpulse.llm.staging import staged

DEPTH, LEAST, TOP = 4, 30, 2000
SCALE, CONTAINED_PERCENT = 2_000_000, 80
SUFFIXES_PER_TASK = 2_000_000
SLICE_BYTES = 4_000_000

_CUTS = {*b".,;:!?", *range(0x0A, 0x0E)}
_WORDS = th.alphabet(set(range(256)) - _CUTS - {0x20, 0x09}, True)
_IS_CUT = np.isin(np.arange(256), list(_CUTS))
_W = [f"w{k + 1}" for k in range(DEPTH)]
_LEAST_BITS, _MOST_BITS, _BUCKET_BITS = 18, 28, 15


class Bitmap:
    """Which 64-bit values may belong to a set: by their highest bits, at most 32 MB."""

    def __init__(self, values: DataFrame, column: str):
        n = values.count()
        self.bits = min(max((16 * n).bit_length(), _LEAST_BITS), _MOST_BITS)
        place = F.shiftrightunsigned(column, 64 - self.bits)
        parts = (values.groupBy(F.shiftright(place, _BUCKET_BITS).alias("bucket"))
                 .agg(F.bitmap_construct_agg(F.pmod(place, F.lit(1 << _BUCKET_BITS))).alias("bitmap")))
        self.data = np.zeros(1 << (self.bits - 3), np.uint8)
        for bucket, bitmap in parts.collect():  # a bounded number of 4 KB rows
            self.data[bucket << (_BUCKET_BITS - 3):(bucket + 1) << (_BUCKET_BITS - 3)] = np.frombuffer(bitmap, np.uint8)

    def may_hold(self, values: np.ndarray) -> np.ndarray:
        place = (values >> np.uint64(64 - self.bits)).astype(np.int64)
        return (self.data[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def _language(name: str) -> np.uint64:
    raw = b"\x01" + name.encode()
    return th.mix(np.frombuffer(raw + bytes(-len(raw) % 8), np.uint64)).sum(dtype=np.uint64)


class Text:
    """A slice of texts: language and id of each word, and whether the next word follows it in its piece."""

    def __init__(self, data: np.ndarray, cuts: np.ndarray, first: int, language: np.ndarray):
        self.data, words = data, th.words_of(data, cuts, _WORDS, first)
        self.start, self.length, doc = words.start, words.length, words.doc_of
        self.doc = first + doc
        self.language = language[self.doc]
        self.word = th.combine(self.language, words.hashes) if len(doc) else words.hashes
        piece = np.cumsum(_IS_CUT[data])[self.start] if len(doc) else doc
        self.follows = (doc[1:] == doc[:-1]) & (piece[1:] == piece[:-1])

    def pairs(self, frequent: Bitmap) -> tuple[np.ndarray, np.ndarray]:
        """(places where a pair of frequent words starts, the pairs' ids)."""
        known = frequent.may_hold(self.word)
        at = np.flatnonzero(self.follows & known[1:] & known[:-1])
        return at, th.combine(self.word[at], self.word[at + 1])


def _texts(batch: pa.RecordBatch) -> Iterator[Text]:
    """Columns text and lang of a batch, in slices."""
    codes = batch.column(1).dictionary_encode()
    table = np.array([_language(x) for x in codes.dictionary.to_pylist()], np.uint64)
    language = table[codes.indices.to_numpy(zero_copy_only=False)] if len(table) else np.empty(0, np.uint64)
    for first, data, cuts in th.text_slices(batch.column(0), SLICE_BYTES):
        yield Text(data, cuts, first, language)


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))


def _emit(source: DataFrame, make: Callable[[Text], list[np.ndarray]], names: list[str]) -> DataFrame:
    """Long columns from each slice of texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in _texts(batch):
                yield pa.RecordBatch.from_arrays([_long(c) for c in make(text)], names=names)
    return source.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def word_counts(source: DataFrame) -> DataFrame:
    """(w1, g, n): every word with its language and number."""
    def make(text: Text) -> list[np.ndarray]:
        known, at, n = np.unique(text.word, return_index=True, return_counts=True)
        return [known, text.language[at], n]
    return _emit(source, make, ["w1", "g", "n"]).groupBy("w1", "g").agg(F.sum("n").alias("n"))


def pair_counts(source: DataFrame, words: Bitmap) -> DataFrame:
    """(pair, n): pairs of neighbouring frequent words."""
    shared = source.sparkSession.sparkContext.broadcast(words)

    def make(text: Text) -> list[np.ndarray]:
        return list(np.unique(text.pairs(shared.value)[1], return_counts=True))
    return _emit(source, make, ["pair", "n"]).groupBy("pair").agg(F.sum("n").alias("n"))


def suffixes(source: DataFrame, words: Bitmap, pairs: Bitmap, hot: np.ndarray) -> DataFrame:
    """(w1, .., w4, n, hot): suffixes that start with a frequent pair, 0 where they have ended."""
    shared = source.sparkSession.sparkContext.broadcast((words, pairs, hot))

    def make(text: Text) -> list[np.ndarray]:
        words_, pairs_, hot_ = shared.value
        at, pair = text.pairs(words_)
        keep = pairs_.may_hold(pair)
        at, pair = at[keep], pair[keep]
        opens = np.zeros(len(text.word) + DEPTH, bool)
        opens[at] = True
        columns, on = [text.word[at], text.word[at + 1]], np.ones(len(at), bool)
        for k in range(1, DEPTH - 1):
            on = on & opens[at + k]
            column = np.zeros(len(at), np.uint64)
            column[on] = text.word[at[on] + k + 1]
            columns.append(column)
        order = np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]
        new = np.ones(len(at), bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        starts = np.flatnonzero(new)
        return [*(c[starts] for c in columns), np.diff(np.append(starts, len(at))), np.isin(pair[order][starts], hot_)]
    return _emit(source, make, [*_W, "n", "hot"])


def quicksort_counts(keys: list[np.ndarray], weight: np.ndarray, whole: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Multikey three-way quicksort of pointers to rows with the given keys; a key of 0 ends its row.

    Yields (depth, a row of each equal partition, its weight). A partition lighter than ``least`` is abandoned, unless its
    row is not ``whole``: then other tasks hold the rest of it. Segments are runs of ``at``, all partitioned at once.
    """
    at, n = np.arange(len(weight)), len(keys)
    size, depth = np.array([len(at)]), np.array([0])
    while len(at):
        start = np.cumsum(size) - size
        segment = np.repeat(np.arange(len(size)), size)
        table = np.stack(keys)
        three = np.stack([table[depth, at[start + (size - 1) * part // 2]] for part in range(3)])
        pivot = np.sort(three, axis=0)[1][segment]
        own = table[depth[segment], at]
        side = 1 + (own > pivot).astype(np.int64) - (own < pivot)
        slot = 3 * segment + side
        sizes = np.bincount(slot, minlength=3 * len(size))
        ends = np.cumsum(sizes)
        place = np.empty(len(at), np.int64)
        for k in range(3):  # stable: a row goes behind those of its side that came before it
            mine = side == k
            rank = np.cumsum(mine)
            before = np.concatenate([[0], rank])[start]
            place[mine] = (ends - sizes)[slot[mine]] + rank[mine] - 1 - before[segment[mine]]
        moved = np.empty_like(at)
        moved[place] = at
        heavy = np.bincount(slot, weights=weight[at], minlength=3 * len(size)).astype(np.int64)
        filled = np.flatnonzero(sizes)
        row = moved[(ends - sizes)[filled]]
        own_depth, equal, heavy = depth[filled // 3], filled % 3 == 1, heavy[filled]
        stays = (heavy >= least) | ~whole[row]
        ended = equal & (table[own_depth, row] == 0)
        for d in range(n):
            found = equal & stays & ~ended & (own_depth == d)
            if found.any():
                yield d, row[found], heavy[found]
        own_depth = own_depth + equal
        stays &= ~ended & (own_depth < n)
        keep = np.zeros(len(sizes), bool)
        keep[filled[stays]] = True
        at = moved[np.repeat(keep, sizes)]
        size, depth = sizes[filled[stays]], own_depth[stays]


def phrase_counts(rows: DataFrame, n_tasks: int, least: int) -> DataFrame:
    """(w1, .., w4, a): phrases of two words and more that occur at least so often; null beyond a phrase's end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [b for b in batches if b.num_rows]
        if not own:
            return
        columns = [np.concatenate([b.column(k).to_numpy() for b in own]) for k in range(DEPTH + 2)]
        words = [c.view(np.uint64) for c in columns[:DEPTH]]
        keys = [th.combine(words[0], words[1]), *words[2:]]
        for depth, row, a in quicksort_counts(keys, columns[DEPTH], columns[DEPTH + 1] == 0, least):
            found = [pa.array(columns[k][row]) if k < depth + 2 else pa.nulls(len(row), pa.int64()) for k in range(DEPTH)]
            yield pa.RecordBatch.from_arrays([*found, pa.array(a)], names=[*_W, "a"])

    split = F.when(F.col("hot") == 1, F.xxhash64("w3", "w4"))
    routed = rows.repartition(n_tasks, F.xxhash64("w1", "w2"), split)
    return (routed.mapInArrow(run, ", ".join(f"{w} long" for w in [*_W, "a"])).groupBy(*_W).agg(F.sum("a").alias("a"))
            .filter(F.col("a") >= least))


def _id(*words: str) -> Column:
    return F.xxhash64(*words)


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """The phrases with length, g, and score, k, l, r of the lowest-scoring cut; contained ones dropped."""
    length = sum(F.col(w).isNotNull().cast("int") for w in _W)
    known = phrases.withColumn("length", length).withColumn("id", F.coalesce(*(
        F.when(length == m, _id(*_W[:m])) for m in range(2, DEPTH + 1))))
    number = words.select(_id("w1").alias("id"), F.col("n").alias("f")).union(known.select("id", F.col("a").alias("f")))
    cuts = F.array_compact(F.array(*(
        F.when(F.col("length") == m, F.struct(F.lit(k).alias("k"), _id(*_W[:k]).alias("left"), _id(*_W[k:m]).alias("right")))
        for m in range(2, DEPTH + 1) for k in range(1, m))))
    halves = known.select("id", "a", F.explode(cuts).alias("cut")).select("id", "a", "cut.*")
    both = (halves.join(number.select(F.col("id").alias("left"), F.col("f").alias("l")), "left")
            .join(number.select(F.col("id").alias("right"), F.col("f").alias("r")), "right"))
    score = F.expr(f"cast({SCALE} as decimal(10, 0)) * cast(a as decimal(20, 0)) div (cast(l as decimal(20, 0)) + r)")
    lowest = both.groupBy("id").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    inner = F.array_compact(F.array(*(
        F.when(F.col("length") == m, _id(*_W[i:i + n])) for m in range(3, DEPTH + 1) for n in range(2, m) for i in range(m - n + 1))))
    longer = known.filter("length > 2").select(F.col("a").alias("longer"), F.explode(inner).alias("id")).groupBy("id").agg(F.max("longer").alias("longer"))
    open_ = (known.join(longer, "id", "left")
             .filter(F.expr(f"longer is null or 100 * cast(longer as decimal(20, 0)) < {CONTAINED_PERCENT} * cast(a as decimal(20, 0))")))
    return open_.join(lowest, "id").join(words.select("w1", "g"), "w1").select("g", "id", *_W, "a", "cut.*")


def _strings(source: DataFrame, words: DataFrame) -> DataFrame:
    """(w, lang, word) of the given words."""
    shared = source.sparkSession.sparkContext.broadcast(Bitmap(words, "w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(1).to_pylist()
            for text in _texts(batch):
                known, at = np.unique(text.word, return_index=True)
                hit = shared.value.may_hold(known)
                known, at = known[hit], at[hit]
                low = np.where((text.data >= 65) & (text.data <= 90), text.data + 32, text.data).astype(np.uint8)
                found = [low[s:s + n].tobytes() for s, n in zip(text.start[at], text.length[at])]
                yield pa.RecordBatch.from_arrays([_long(known), pa.array([names[d] for d in text.doc[at]], pa.string()),
                                                  pa.array(found, pa.binary()).cast(pa.string())], names=["w", "lang", "word"])
    return source.mapInArrow(run, "w long, lang string, word string").groupBy("w").agg(F.min(F.struct("lang", "word")).alias("s")).select("w", "s.*").join(words, "w")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases."""
    spark = docs.sparkSession
    source = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    every = staged(word_counts(source), "words")
    totals = every.groupBy("g").agg(F.sum("n").alias("n"))
    words = every.filter(F.col("n") >= least)
    frequent = Bitmap(words, "w1")
    pairs = staged(pair_counts(source, frequent).filter(F.col("n") >= least), "pairs")
    n_suffixes = pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_suffixes // SUFFIXES_PER_TASK))
    share = max(n_suffixes // n_tasks, 1)
    hot = [r.pair for r in pairs.filter(F.col("n") > share).select("pair").collect()]  # fewer than there are tasks
    rows = suffixes(source, frequent, Bitmap(pairs, "pair"), np.array(hot, np.int64).view(np.uint64))
    phrases = staged(phrase_counts(rows, n_tasks, least), "phrases")
    best = Window.partitionBy("g").orderBy(F.desc("score"), F.desc("a"))
    ranked = staged(scored(phrases, words).withColumn("place", F.rank().over(best)).filter(F.col("place") <= top), "ranked")
    spelled = ranked.select("id", F.posexplode(F.array(*_W)).alias("pos", "w")).filter("w is not null")
    strings = staged(_strings(source, spelled.select("w").distinct()), "strings")
    text = (spelled.join(strings, "w").groupBy("id").agg(F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("words"))
            .select("id", "lang", F.array_join("words.word", " ").alias("phrase")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (ranked.join(text, "id").join(totals, "g").withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
