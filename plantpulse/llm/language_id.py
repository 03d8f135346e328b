"""Language identification by unigram pieces, summed over all segmentations.

Pieces come from a fixed public vocabulary. Training gives each language a probability for each
piece: the expected number of times it occurs when every segmentation of a word counts in proportion
to its product of equal piece weights (one forward-backward step). Prediction sums, with the
forward algorithm, the probability of all segmentations of each word under each language; a text's
score is the sum over its words. Words are runs of letters in lower case, marked at their start.

Only piece counts leave the training tasks: at most vocabulary size times languages numbers, however
large the corpus. The model is such a table too, and is what every task gets.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is every text when
nothing could be learnt; rows with a null language are not learnt from; ties go to the language that sorts
first; repeated rows count as often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantpulse.llm import text_hash as th
from plantpulse.llm.mapping import beside
from plantpulse.llm.staging import staged

VOCABULARY = "piece_bpe_32k.model"
MAX_LANGUAGES = 256  # of one model
SMOOTHING = 0.1
TRAINING_ROWS = 3000  # texts whose words are looked at together
UNKNOWN_LOG = -18.0  # of a single character that is no piece
MARK = "▁"
_WORD, _LETTERS = re.compile(r"[^\W\d_]+"), regex.compile(r"\p{L}+")


class Pieces:
    """The vocabulary as sorted hashes of character sequences."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())
                 if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        names = sorted(n for n in set(names) if all(c == MARK or c.isalpha() for c in n))
        self.longest = max(map(len, names))
        hashes = np.array([_sequence(np.array([[*map(ord, n)]], np.uint64))[0] for n in names], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.names, self.size = hashes[order], [names[i] for i in order], len(names)

    def at(self, hashes: np.ndarray) -> np.ndarray:
        """Number of the piece, or size for none."""
        place = np.minimum(np.searchsorted(self.hashes, hashes), self.size - 1)
        return np.where(self.hashes[place] == hashes, place, self.size)


def _sequence(codes: np.ndarray) -> np.ndarray:
    out = np.zeros(codes.shape[0], np.uint64)
    for column in codes.T:
        out = _step(out, column)
    return out


def _step(state: np.ndarray, code: np.ndarray) -> np.ndarray:
    return th.mix(state * np.uint64(0x9E3779B97F4A7C15) + code + np.uint64(1))


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


@dataclass
class Block:
    """Different words of some texts, by length, and how texts use them."""

    words: list[str]
    use: np.ndarray  # word number of each occurrence
    counts: np.ndarray  # occurrences in each text


def block_of(texts: list[str | None]) -> Block:
    seen: dict[str, int] = {}
    use: list[int] = []
    counts = []
    for text in texts:
        found = _WORD.findall(text.lower()) if text else ()
        use += [seen.setdefault(w, len(seen)) for w in found]
        counts.append(len(found))
    # numerals that are no letters count as word characters above
    words = [w if w.isalpha() else "".join(_LETTERS.findall(w)) for w in seen]
    return Block(words, np.array(use, np.int64), np.array(counts, np.int64))


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word numbers, code points with the start mark), words of one length at a time."""
    length = np.array([len(w) for w in words], np.int64)
    order = np.argsort(length, kind="stable")
    order = order[np.searchsorted(length[order], 1):]
    for numbers in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
        n = int(length[numbers[0]])
        step = max(1, 200_000 // n)
        for first in range(0, len(numbers), step):
            some = numbers[first:first + step]
            codes = np.frombuffer("".join([MARK + words[i] for i in some]).encode("utf-32-le"), np.uint32)
            yield some, codes.reshape(len(some), n + 1)


def _matches(codes: np.ndarray, known: Pieces) -> Iterator[tuple[int, list[tuple[int, np.ndarray]]]]:
    """For each end place the (length, piece numbers) of what may end there."""
    states: list[tuple[int, np.ndarray]] = []  # sequences that are open: where they start, their hash
    for end in range(1, codes.shape[1] + 1):
        code = codes[:, end - 1].astype(np.uint64)
        states = [(s, _step(h, code)) for s, h in [*states, (end - 1, np.zeros(len(codes), np.uint64))] if end - s <= known.longest]
        yield end, [(end - s, known.at(h)) for s, h in states]


def log_likelihoods(words: list[str], known: Pieces, model: np.ndarray) -> np.ndarray:
    """(words, languages): log of the summed probability of all segmentations."""
    out = np.zeros((len(words), model.shape[1]))
    table = np.vstack([np.exp(model), np.zeros(model.shape[1])])
    for numbers, codes in _by_length(words):
        alpha, scale = [np.ones((len(numbers), model.shape[1]))], np.zeros((len(numbers), model.shape[1]))
        for end, found in _matches(codes, known):
            now = np.zeros_like(alpha[-1])
            for size, piece in found:
                p = table[piece]
                if size == 1:
                    p = np.where((piece == known.size)[:, None], np.exp(UNKNOWN_LOG), p)
                now += alpha[-size] * p
            # the open places are scaled together, so long words don't underflow
            scale += np.log(now)
            alpha = [*(a / now for a in alpha[-known.longest + 1:]), np.ones_like(now)]
        out[numbers] = scale
    return out


def expected_pieces(words: list[str], known: Pieces, weight: np.ndarray) -> np.ndarray:
    """(languages, pieces): expected counts under equal piece weights; weight is (words, languages)."""
    out = np.zeros((weight.shape[1], known.size + 1))
    equal = 1.0 / 64
    for numbers, codes in _by_length(words):
        n = codes.shape[1]
        found = [f for _, f in _matches(codes, known)]
        allowed = [[(size, piece, (piece < known.size) * equal + ((piece == known.size) & (size == 1)) * equal ** 2)
                    for size, piece in f] for f in found]
        log_scale = np.zeros((len(numbers), n + 1))
        alpha = np.zeros((n + 1, len(numbers)))
        alpha[0] = 1
        for end in range(1, n + 1):
            total = np.zeros(len(numbers))
            for size, _, p in allowed[end - 1]:
                total += alpha[end - size] * p * np.exp(log_scale[:, end - size] - log_scale[:, end - 1])
            alpha[end] = 1
            log_scale[:, end] = log_scale[:, end - 1] + np.log(total)
        # backward chances that a segmentation has a cut at each place, from the end
        cut = np.zeros((n + 1, len(numbers)))
        cut[n] = 1
        for end in range(n, 0, -1):
            for size, piece, p in allowed[end - 1]:
                share = cut[end] * alpha[end - size] * p * np.exp(log_scale[:, end - size] - log_scale[:, end])
                cut[end - size] += share
                some = np.flatnonzero((piece < known.size) & (share > 0))
                for language in range(weight.shape[1]):
                    w = weight[numbers[some], language]
                    used = w > 0
                    if used.any():
                        np.add.at(out[language], piece[some[used]], share[some[used]] * w[used])
    return out[:, :known.size]


Model = tuple[list[str], np.ndarray]


def learnt_groups(docs: DataFrame, language: str = "lang", path: str | None = None) -> list[Model]:
    """One model for each ``MAX_LANGUAGES`` languages in order: as many as there are, each of bounded size."""
    rows = docs.filter(F.col(language).isNotNull() & F.col("text").isNotNull())
    names = sorted(r[0] for r in rows.select(F.col(language)).distinct().collect())  # names only
    groups = [names[i:i + MAX_LANGUAGES] for i in range(0, len(names), MAX_LANGUAGES)] or [[]]
    return [learnt(rows if len(groups) == 1 else rows.filter(F.col(language).isin(g)), language, path, g) for g in groups]


def learnt(docs: DataFrame, language: str = "lang", path: str | None = None, languages: list[str] | None = None) -> Model:
    """Languages, in order, and the log probability of each piece under each (pieces, languages)."""
    path = path or public_tokenizers.path(VOCABULARY)
    rows = docs.filter(F.col(language).isNotNull() & F.col("text").isNotNull())
    if languages is None:
        languages = sorted(r[0] for r in rows.select(F.col(language)).distinct().collect())
    number = {name: i for i, name in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = pieces(path), np.zeros((len(languages), pieces(path).size))
        for whole in batches:
            for first in range(0, whole.num_rows, TRAINING_ROWS):
                batch = whole.slice(first, TRAINING_ROWS)
                block = block_of(batch.column(0).to_pylist())
                tongue = np.repeat([number[x] for x in batch.column(1).to_pylist()], block.counts).astype(np.int64)
                weight = np.bincount(block.use * len(languages) + tongue, minlength=len(block.words) * len(languages))
                weight = weight.reshape(len(block.words), len(languages)).astype(float)
                total += expected_pieces(block.words, known, weight)
        tongue, piece = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(tongue, pa.int32()), pa.array(piece, pa.int32()), pa.array(total[tongue, piece])],
                                         names=["language", "piece", "n"])

    counts = np.zeros((pieces(path).size, len(languages)))
    found = (rows.select("text", F.col(language).alias("language")).mapInArrow(count, "language int, piece int, n double")
             .groupBy("language", "piece").agg(F.sum("n").alias("n")).toArrow())  # bounded: pieces x languages
    counts[found["piece"].to_numpy(), found["language"].to_numpy()] = found["n"].to_numpy()
    counts += SMOOTHING
    return languages, np.log(counts / counts.sum(axis=0, keepdims=True)) if languages else counts


def identify(docs: DataFrame, model: Model | list[Model], carry: list[str] | None = None, path: str | None = None) -> DataFrame:
    """``row``, lang_pred and score (the chance of that language among those learnt).

    With several models the documents pass by one after the other, staged in between; best language and sum of
    likelihoods are put together, so the result is that of one model of all languages.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    models = model if isinstance(model, list) else [model]
    carried = docs.columns if carry is None else carry
    value = F.struct(F.col("text").alias("text"), F.lit("und").alias("lang"), F.lit(None).cast("double").alias("top"), F.lit(0.0).alias("total"))
    passed = docs.select(F.struct(*(F.col(f"`{c}`") for c in carried)).alias("kept"), value.alias("value"))
    for turn, one in enumerate(models):
        found = beside(passed, _judge(docs.sparkSession.sparkContext.broadcast(one), path), _STATE, ["kept"] if one is models[-1] else ["kept", "value"], text="value")
        if one is not models[-1]:
            now = F.struct(F.col("row.value.text").alias("text"), F.col("lang").alias("lang"), F.col("top").alias("top"), F.col("total").alias("total"))
            passed = staged(found.select(F.col("row.kept").alias("kept"), now.alias("value")), f"languages-{turn}")
    return found.select(F.col("row.kept").alias("row"), F.col("lang").alias("lang_pred"), F.when(F.col("top").isNull(), 0.0).otherwise(1 / F.col("total")).alias("score"))


_STATE = "lang string, top double, total double"


def _judge(shared, path: str):
    """Best language so far, its log likelihood, and the sum of all likelihoods relative to it."""
    def make():
        languages, table = shared.value
        known = pieces(path)

        def predict(values: pa.Array) -> list[pa.Array]:
            texts, before = values.field(0), [values.field(k) for k in (1, 2, 3)]
            if not languages:
                return before
            block = block_of(texts.to_pylist())
            by_word = log_likelihoods(block.words, known, table)
            letters = np.array([len(w) for w in block.words], np.int64)
            bounds = np.concatenate([[0], np.cumsum(block.counts)])
            sums = np.zeros((len(texts), len(languages)))
            for d, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
                word, times = np.unique(block.use[a:b], return_counts=True)
                sums[d] = times @ by_word[word]
            some = np.concatenate([[0], np.cumsum(letters[block.use])])
            some = some[bounds[1:]] > some[bounds[:-1]]
            best, own_top = sums.argmax(axis=1), sums.max(axis=1)
            own_total = np.exp(sums - own_top[:, None]).sum(axis=1)
            old = before[1].to_numpy(zero_copy_only=False)
            old_top = np.where(np.isnan(old), -np.inf, old)
            top = np.maximum(old_top, own_top)
            total = before[2].to_numpy(zero_copy_only=False) * np.exp(old_top - top) + own_total * np.exp(own_top - top)
            was = before[0].to_pylist()
            name = [(languages[b] if own > past else w) if s else "und" for b, own, past, w, s in zip(best, own_top, old_top, was, some)]
            return [pa.array(name, pa.string()), pa.array(top, pa.float64(), mask=~some), pa.array(total)]
        return predict
    return make
