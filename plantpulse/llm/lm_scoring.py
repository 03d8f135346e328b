"""Stupid-backoff scores from n-gram counts of the whole corpus, as joins of hashed tables.

Documents are staged in chunks. The n-grams of each chunk, each once with its count, are dealt by hash
into buckets; a bucket's task adds up the counts of all chunks and answers every chunk with the
corpus counts of the n-grams it sent. Answers are joined to the chunks, and each document's scores are
summed from them. An n-gram that stands in every document is one entry per chunk, the
number of buckets follows the number of words, and a task holds one bucket or one chunk.

A word's score is ``c(history word) / c(history)`` from the longest history that occurs, times
``BACKOFF`` for each word dropped from the history; a word that occurs nowhere else counts as one in all
words plus one. A document's own occurrences are left out of its counts, else every n-gram would be known.

N-grams are compared by 64-bit hashes. From trigrams on each order waits for the answers to the one before:
an n-gram that stands in another document has its first and its last n - 1 words there too, so those
that lack one of them are known to stand nowhere else and are not sent. No count changes by it.

``order`` is a parameter: 3 unless told otherwise.

:func:`lm_scores_joined` gives the same scores in the plainly relational form: exploded n-grams as rows, a count table by hash, a join,
a sum per document.

Defined results: null and empty texts have no words, score 0 and no mean; repeated rows are other
documents for each other; an empty table gives an empty result; the input's columns stay in ``row``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantpulse.llm import text_hash as th
from plantpulse.llm.staging import bucketed

ORDER, BACKOFF = 3, 0.4
CHUNK_DOCS, CHUNK_BYTES = 2000, 6_000_000
BUCKET_NGRAMS = 2_000_000
#: Orders whose n-grams are all sent; from the next on only those whose two parts stand in another document.
UNSIFTED = 2
#: Low bytes of a step between hashes that compression would not shorten.
RAW_BYTES = 5


def _planes(values: np.ndarray) -> np.ndarray:
    """Bytes of like weight together, lowest first: those of small numbers are runs of zeros."""
    return values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T


def _joined(planes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1)


def _pack(values: np.ndarray) -> bytes:
    return zlib.compress(_planes(values).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return _joined(np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)).astype(np.int64)


def _pack_rising(hashes: np.ndarray) -> bytes:
    """Rising 64-bit hashes, whole, as steps: the high bytes of steps are few, the low ones are left as they are."""
    planes = _planes(np.diff(hashes, prepend=np.uint64(0)))
    return planes[:RAW_BYTES].tobytes() + zlib.compress(planes[RAW_BYTES:].tobytes(), 1)


def _unpack_rising(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(data[:RAW_BYTES * n], np.uint8).reshape(RAW_BYTES, n)
    return np.cumsum(_joined(np.concatenate([raw, np.frombuffer(zlib.decompress(data[RAW_BYTES * n:]), np.uint8).reshape(8 - RAW_BYTES, n)])), dtype=np.uint64)


def chunks(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """(chunk, n_words, docs array<struct<row, text>>), bucketed by chunk."""
    carried = docs.columns if carry is None else carry
    source = docs.select(F.struct(F.struct(*(F.col(f"`{c}`") for c in carried)).alias("row"), F.col("text").alias("text")).alias("doc"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            column, lo = batch.column(0), 0
            text = column.field("text")
            ends = np.cumsum([0 if n is None else n for n in pc.binary_length(text).to_pylist()])
            while lo < len(column):
                before = ends[lo - 1] if lo else 0
                hi = min(max(lo + 1, int(np.searchsorted(ends, before + CHUNK_BYTES, side="right"))), lo + CHUNK_DOCS, len(column))
                some = column.slice(lo, hi - lo)
                words = sum(int(w.counts.sum()) for w in th.slices(some.field("text"), th.LOWERED))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.array([words], pa.int64()), pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), some)],
                    names=["chunk", "n_words", "docs"])
                number, lo = number + 1, hi

    kind = source.schema["doc"].dataType.simpleString()
    return bucketed(source.mapInArrow(run, f"chunk long, n_words long, docs array<{kind}>"), "chunk", "chunks")


class ChunkGrams:
    """N-grams of a chunk's texts at each order up to ``order``, and what the answers say of the first ``answered`` orders.

    ``known`` and ``count`` hold each n-gram once, ``asked`` the places in ``known`` that are sent, and
    ``other``, by the place where an n-gram starts, its count outside its own document.
    """

    def __init__(self, texts: pa.Array, order: int, n_buckets: int, answered: int = 0, answers: list[dict] | None = None):
        parts = list(th.slices(texts, th.LOWERED))
        self.counts = np.concatenate([w.counts for w in parts]) if parts else np.empty(0, np.int64)
        words = th.Words(0, self.counts, np.concatenate([w.hashes for w in parts]) if parts else np.empty(0, np.uint64))
        self.words, self.doc, self.n_buckets = words, words.doc_of, n_buckets
        self.known, self.count, self.asked, self.other = [], [], [], []
        for level in range(order):
            starts = th.window_starts(words, level + 1)
            known, at, count = np.unique(th.runs(words.hashes, level + 1)[starts], return_inverse=True, return_counts=True)
            if level < UNSIFTED:
                asked = np.arange(len(known))
            else:  # what stands in another document has both its parts there
                asked = np.unique(at[(self.other[-1][starts] > 0) & (self.other[-1][starts + 1] > 0)])
            self.known.append(known)
            self.count.append(count)
            self.asked.append(asked)
            if level < answered:
                total, ends = np.zeros(len(known), np.int64), self.ends(level)
                for a in answers or []:
                    if a["bucket"] // n_buckets == level:
                        bucket = a["bucket"] % n_buckets
                        total[asked[ends[bucket - 1] if bucket else 0:ends[bucket]]] = _unpack(a["counts"])
                _, mine, times = np.unique(self.doc[starts] * np.int64(max(len(known), 1)) + at, return_inverse=True, return_counts=True)
                other = np.zeros(len(self.doc), np.int64)
                other[starts] = np.maximum(total[at] - times[mine], 0)  # not asked: nowhere else
                self.other.append(other)

    def ends(self, level: int) -> np.ndarray:
        """Where each bucket ends in ``asked``: buckets are ranges of hashes."""
        bucket = (((self.known[level][self.asked[level]] >> np.uint64(32)) * np.uint64(self.n_buckets)) >> np.uint64(32)).astype(np.int64)
        return np.cumsum(np.bincount(bucket, minlength=self.n_buckets))


def _sent(first: int, last: int, n_buckets: int):
    """N-grams of the levels from ``first`` to before ``last``, once those before ``first`` are answered."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, docs, answers in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                own = ChunkGrams(docs.values.field("text"), last, n_buckets, first, answers.as_py())
                rows = []
                for level in range(first, last):
                    known, count = (x[level][own.asked[level]] for x in (own.known, own.count))
                    ends = own.ends(level)
                    for bucket, (lo, hi) in enumerate(zip([0, *ends[:-1]], ends)):
                        if hi > lo:
                            rows.append((level * n_buckets + bucket, number, _pack_rising(known[lo:hi]), _pack(count[lo:hi])))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))],
                        names=["bucket", "chunk", "hashes", "counts"])
    return run


def _answered(table: pa.Table) -> pa.Table:
    """Corpus counts for each chunk's n-grams of one bucket, in the order sent."""
    counts = [_unpack(c.as_buffer()) for c in table["counts"]]
    hashes = [_unpack_rising(h.as_buffer().to_pybytes(), len(c)) for h, c in zip(table["hashes"], counts)]
    _, at = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)[at]
    parts = np.split(total, np.cumsum([len(h) for h in hashes])[:-1])
    return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "counts": pa.array([_pack(p) for p in parts], pa.binary())})


def _scores(order: int, n_buckets: int, n_words: int, backoff: float):
    def one(docs: pa.Array, answers: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        own = ChunkGrams(docs.field("text"), order, n_buckets, order, answers)
        n, doc, counts = own.counts, own.doc, own.other
        everything = n_words - n[doc] if len(doc) else np.empty(0)
        place = np.arange(len(doc)) - own.words.bounds[doc] if len(doc) else np.empty(0, np.int64)
        result, open_ = np.zeros(len(doc)), np.ones(len(doc), bool)
        for level in range(order - 1, -1, -1):
            can = np.flatnonzero(open_ & (place >= level))
            seen = can[counts[level][can - level] > 0]
            history = counts[level - 1][seen - level] if level else everything[seen]
            dropped = np.minimum(order - 1, place[seen]) - level
            result[seen] = np.log(counts[level][seen - level] / history) + dropped * np.log(backoff)
            open_[seen] = False
        rest = np.flatnonzero(open_)
        result[rest] = np.minimum(order - 1, place[rest]) * np.log(backoff) - np.log(everything[rest] + 1.0)
        return n, np.bincount(doc, weights=result, minlength=len(n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, answers in zip(batch.column(1), batch.column(2)):
                n, score = one(docs.values, answers.as_py())
                yield pa.RecordBatch.from_arrays([docs.values.field("row"), pa.array(n, pa.int64()), pa.array(score, pa.float64())],
                                                 names=["row", "n_words", "log_score"])
    return run


def lm_scores(docs: DataFrame, carry: list[str] | None = None, order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """``row``, n_words and log_score: the sum of the words' log scores."""
    table = chunks(docs, carry)
    n_words = table.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    n_buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_words // BUCKET_NGRAMS))
    none = F.array().cast("array<struct<bucket: bigint, counts: binary>>")
    chunked, first = table.select("chunk", "docs", none.alias("answers")), 0
    for last in (min(order, UNSIFTED), *range(UNSIFTED + 1, order + 1)):
        sent = chunked.mapInArrow(_sent(first, last, n_buckets), "bucket long, chunk long, hashes binary, counts binary")
        more = (sent.groupBy("bucket").applyInArrow(_answered, "chunk long, bucket long, counts binary")
                .groupBy("chunk").agg(F.collect_list(F.struct("bucket", "counts")).alias("more")))
        if last < order:  # read twice: to choose what the next order asks for, and to score
            more = bucketed(more, "chunk", "answers")
        chunked = chunked.join(more, "chunk", "left").select("chunk", "docs", F.concat("answers", F.coalesce("more", none)).alias("answers"))
        first = last
    row = table.schema["docs"].dataType.elementType["row"].dataType.simpleString()
    return chunked.mapInArrow(_scores(order, n_buckets, n_words, backoff), f"row {row}, n_words long, log_score double")


def lm_scores_joined(docs: DataFrame, carry: list[str] | None = None, order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """The scores of :func:`lm_scores` by joins of rows, order by order.

    Every document's n-grams are rows (hash, document, number); summed by hash they are the count table, of which only what
    two documents have is kept, and joined by hash they bring each document its counts. From trigrams on an n-gram is
    only a row if both its parts came back. A frequent n-gram is one row a document, on the side of the join that Spark splits.
    """
    carried = docs.columns if carry is None else carry
    row = F.struct(*(F.col(f"`{c}`") for c in carried)).alias("row")
    rows_to_buckets = docs.select(F.monotonically_increasing_id().alias("d"), row, F.coalesce("text", F.lit("")).alias("text"))
    table = bucketed(rows_to_buckets.repartition("d"), "d", "lm_texts")
    found, names = table, []
    for level in range(order):
        source = found.select("d", "text", *names)
        grams = source.mapInArrow(_grams(level), "h long, d long, n long")
        counts = grams.groupBy("h").agg(F.sum("n").alias("c"), F.count("*").alias("documents")).filter("documents > 1").select("h", "c")
        own = bucketed(grams.join(counts, "h").groupBy("d").agg(F.collect_list("h").alias(f"h{level}"), F.collect_list("c").alias(f"c{level}")), "d", "lm_counts")
        found = found.join(own, "d", "left")
        names += [f"h{level}", f"c{level}"]
    n_words = table.select("text").mapInArrow(_word_numbers, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    kind = table.schema["row"].dataType.simpleString()
    return found.select("row", "text", *names).mapInArrow(_summed_scores(order, n_words, backoff), f"row {kind}, n_words long, log_score double")


def _word_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words in th.slices(batch.column(0), th.LOWERED):
            yield pa.RecordBatch.from_arrays([pa.array([int(words.counts.sum())], pa.int64())], names=["n"])


def _documents(batch: pa.RecordBatch, text: int, first: int, levels: int) -> Iterator[tuple[int, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """(place, words, for each level the sorted hashes that other documents have too and their counts) of every text."""
    for words in th.slices(batch.column(text), th.LOWERED):
        bounds = words.bounds
        for k in range(words.n_docs):
            known = []
            for level in range(levels):
                h, c = (batch.column(first + 2 * level + side)[words.first + k].values for side in (0, 1))
                h, c = (np.empty(0, np.int64) if x is None else x.to_numpy() for x in (h, c))
                order = np.argsort(h.view(np.uint64))
                known.append((h.view(np.uint64)[order], c[order]))
            yield words.first + k, words.hashes[bounds[k]:bounds[k + 1]], known


def _grams(level: int):
    """Rows (h, d, n): each different n-gram of a document with its number there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = batch.column(0).to_numpy(), []
            for place, hashes, known in _documents(batch, 1, 2, level):
                grams = th.runs(hashes, level + 1)
                if level >= UNSIFTED and len(grams):
                    both = np.isin(th.runs(hashes, level), known[-1][0])
                    grams = grams[both[:-1] & both[1:]]
                h, n = np.unique(grams, return_counts=True)
                parts.append((h, np.full(len(h), ids[place]), n))
            if parts:
                h, d, n = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(d, pa.int64()), pa.array(n, pa.int64())], names=["h", "d", "n"])
    return run


def _summed_scores(order: int, n_words: int, backoff: float):
    def one(hashes: np.ndarray, known: list[tuple[np.ndarray, np.ndarray]]) -> float:
        n, everything, other = len(hashes), n_words - len(hashes), []
        for level, (h, c) in enumerate(known):
            own, at, times = np.unique(th.runs(hashes, level + 1), return_inverse=True, return_counts=True)
            total = np.zeros(len(own), np.int64)
            if len(h):
                place = np.minimum(np.searchsorted(h, own), len(h) - 1)
                total = np.where(h[place] == own, c[place] - times, 0)
            other.append(total[at])
        place, result, open_ = np.arange(n), np.zeros(n), np.ones(n, bool)
        for level in range(order - 1, -1, -1):
            can = np.flatnonzero(open_ & (place >= level))
            seen = can[other[level][can - level] > 0]
            history = other[level - 1][seen - level] if level else everything
            result[seen] = np.log(other[level][seen - level] / history) + (np.minimum(order - 1, seen) - level) * np.log(backoff)
            open_[seen] = False
        rest = np.flatnonzero(open_)
        result[rest] = np.minimum(order - 1, rest) * np.log(backoff) - np.log(everything + 1.0)
        return float(result.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(hashes), one(hashes, known)) for _, hashes, known in _documents(batch, 1, 2, order)]
            n, score = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(score, pa.float64())], names=["row", "n_words", "log_score"])
    return run
