"""Toxicity by weak supervision: many voters, a generative model of their votes, a linear classifier of its posteriors.

Voters fire or don't on a whole text. Some look for words of fixed lexicons, some for patterns (shouting, runs of exclamation
marks, disguised spelling, a lexicon word near ``you``), some for telling words and word beginnings mined from the
labelled sample. The label model has one hidden class: each voter's chance to fire depends on the class and, where two voters
are correlated beyond it, on one other voter (a forest, grown by the strongest correlation first). Expectation maximisation fits it to the
counts of vote patterns over all documents, in which labelled ones have their class given. Its posterior of each pattern
is the label of every document that the linear classifier learns from; the classifier sees all telling features and
so scores what the voters treat alike.

Labels come from a bounded sample of rows, at most ``MAX_LABELLED``, one for each (doc_id, label); features are mined from
their whole texts in Spark. Votes and feature bits of all documents are staged (some 50 bytes each); the driver gets at most
``2**VOTERS`` pattern counts and, for each Newton step, one sum of fixed size.

Defined results: null and empty texts have no votes and are scored like any text; null labels are not used; without labels
the lexicons and patterns vote alone; a repeated labelled doc_id is one row of the sample, repeated rows are scored one by one; an
empty table gives no rows; texts of any length count whole; the input's columns stay in ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantpulse.llm import text_hash as th
from plantpulse.llm.mapping import beside
from plantpulse.llm.quality_classifier import summed
from plantpulse.llm.staging import staged

MAX_LABELLED = 20_000
FEATURES, LEAST_DOCUMENTS, LEAST_CHI_SQUARED, LEAST_SHARE = 256, 3, 12.0, 0.5
PREFIXES = range(3, 8)  # bytes
PENALTY, STEPS = 0.3, 15
ROUNDS, LEAST_INFORMATION = 60, 0.002

# Common English insults by theme.
LEXICONS = (
    ("idiot", "idiots", "moron", "morons", "stupid", "dumb", "fool", "imbecile", "dimwit"),
    ("worthless", "pathetic", "loser", "losers", "useless", "failure"),
    ("disgusting", "trash", "scum", "filth", "garbage", "vile", "vermin"),
    ("clown", "clowns", "freak", "creep", "jerk", "coward"),
)
ADDRESS = ("you", "your", "youre")
N_PATTERNS = 4
MINED = 8
VOTERS = len(LEXICONS) + N_PATTERNS + MINED

_LEET = th.alphabet({*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), 0x40, 0x24, *range(0x80, 0x100)}, True)
for _sign, _letter in zip(b"013457@$", b"oieastas"):
    _LEET.value[_sign] = _LEET.value[_letter]


def _hashes(words: tuple[str, ...]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    return np.sort(th.words_of(data, np.array([0, len(data)]), th.ALPHANUMERIC).hashes)


_OWN = [_hashes(words) for words in LEXICONS]
_ALL, _YOU = np.sort(np.concatenate(_OWN)), _hashes(ADDRESS)


def _codes(data: np.ndarray, words: th.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of words, feature codes): the words whole, then their beginnings of each length, packed into a number."""
    yield np.arange(len(words.hashes)), words.hashes
    low = np.where((data >= 65) & (data <= 90), data + 32, data)
    at, code = np.arange(len(words.hashes)), np.zeros(len(words.hashes), np.uint64)
    for k in range(PREFIXES.stop - 1):
        longer = words.length[at] > k
        at, code = at[longer], code[longer]
        code |= low[words.start[at] + k].astype(np.uint64) << np.uint64(8 * k)
        if k + 1 in PREFIXES:
            yield at, code | np.uint64((k + 1) << 56)


def features_of(data: np.ndarray, words: th.Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, code) of every different feature of every text of a slice."""
    doc, pairs = words.doc_of, []
    for at, code in _codes(data, words):
        pairs.append(np.stack([doc[at].astype(np.uint64), code], axis=1))
    every = np.concatenate(pairs)
    order = np.lexsort((every[:, 1], every[:, 0]))
    every = every[order]
    new = np.ones(len(every), bool)
    new[1:] = (every[1:] != every[:-1]).any(axis=1)
    return every[new, 0].astype(np.int64), every[new, 1]


def _member(sorted_: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which values are members, their place among the members)."""
    if not len(sorted_):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    place = np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)
    return sorted_[place] == values, place


@dataclass
class Features:
    """The codes that the classifier sees (sorted), and for each the mined voter that uses it, -1 for none."""

    codes: np.ndarray
    voter: np.ndarray

    @staticmethod
    def mined(codes: np.ndarray, strong: np.ndarray) -> Features:
        """From codes by falling worth: the strong ones are dealt in turn to the mined voters; the lexicons' words come along."""
        turn = np.full(len(codes), -1)
        turn[strong] = np.arange(int(strong.sum())) % MINED
        known = np.unique(np.concatenate([codes, _ALL]))
        voter = np.full(len(known), -1)
        voter[np.searchsorted(known, codes)] = turn
        return Features(known, voter)

    def measure(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(presence of every feature, votes as the bits of a number) for each text."""
        bits, votes = [], []
        for first, data, cuts in th.text_slices(texts):
            words = th.words_of(data, cuts, th.ALPHANUMERIC, first)
            n, doc = words.n_docs, words.doc_of
            seen = np.zeros((n, len(self.codes)), bool)
            for at, code in _codes(data, words):
                hit, place = _member(self.codes, code)
                seen[doc[at[hit]], place[hit]] = True
            bits.append(seen)
            fired = np.zeros((n, VOTERS), bool)
            for k, own in enumerate(_OWN):
                fired[doc[_member(own, words.hashes)[0]], k] = True
            insult, you = _member(_ALL, words.hashes)[0], _member(_YOU, words.hashes)[0]
            letters, capitals = (np.diff(np.concatenate([[0], np.cumsum(x)])[cuts]) for x in
                                 (((data | 32) >= 97) & ((data | 32) <= 122), (data >= 65) & (data <= 90)))
            shout = np.diff(np.concatenate([[0], np.cumsum(data == 33)])[cuts])
            k = len(_OWN)
            fired[:, k] = (letters >= 20) & (2 * capitals > letters)
            fired[:, k + 1] = 10 * shout > words.counts + 20
            leet = th.words_of(data, cuts, _LEET, first)
            disguised = np.bincount(leet.doc_of[_member(_ALL, leet.hashes)[0]], minlength=n) > np.bincount(doc[insult], minlength=n)
            fired[:, k + 2] = disguised
            near = np.zeros(len(insult), bool)
            for step in range(1, 4):  # an insult at most three words from ``you``, in one text
                both = (insult[step:] & you[:-step] | you[step:] & insult[:-step]) & (doc[step:] == doc[:-step])
                near[step:] |= both
            fired[doc[near], k + 3] = True
            for j in range(MINED):
                fired[:, k + N_PATTERNS + j] = seen[:, self.voter == j].any(axis=1)
            votes.append(fired @ (1 << np.arange(VOTERS)))
        return np.concatenate(bits), np.concatenate(votes).astype(np.int32)


def labelled_texts(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, toxic, text) of at most ``max_labelled`` rows, staged: one for each (doc_id, label)."""
    wanted = staged(labels.filter("doc_id is not null and toxic is not null").select("doc_id", (F.col("toxic") == 1).cast("int").alias("toxic"))
                    .join(docs.select("doc_id").filter("doc_id is not null").distinct(), "doc_id").distinct()
                    .orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_labelled), "toxic-wanted")
    ids = wanted.select("doc_id").distinct()
    least = docs.select("doc_id", F.xxhash64("text").alias("fingerprint")).join(ids, "doc_id").groupBy("doc_id").agg(F.min("fingerprint").alias("fingerprint"))
    one = docs.select("doc_id", "text", F.xxhash64("text").alias("fingerprint")).join(staged(least, "toxic-chosen"), ["doc_id", "fingerprint"])
    return staged(one.groupBy("doc_id").agg(F.first("text").alias("text")).join(wanted, "doc_id").select("doc_id", "toxic", "text"), "toxic-sample")


def mine(sample: DataFrame) -> Features:
    """Features whose presence differs most between the labels; strong ones stand mostly in toxic texts."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy()
            for first, data, cuts in th.text_slices(batch.column(0)):
                words = th.words_of(data, cuts, th.ALPHANUMERIC, first)
                doc, code = features_of(data, words)
                known, at = np.unique(code, return_inverse=True)
                bad = toxic[first + doc] == 1
                yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(np.bincount(at, minlength=len(known)), pa.int64()),
                                                  pa.array(np.bincount(at[bad], minlength=len(known)), pa.int64())], names=["h", "n", "bad"])

    n, n_bad = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < n_bad < n:
        return Features.mined(np.empty(0, np.uint64), np.empty(0, bool))
    expected = F.col("n") * (n_bad / n)
    value = (F.col("bad") - expected) ** 2 / (expected * (1 - n_bad / n) * (1 - F.col("n") / n) + 1e-9)
    found = (sample.select("text", "toxic").mapInArrow(count, "h long, n long, bad long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
             .filter(F.col("n") >= LEAST_DOCUMENTS).select("h", (F.col("bad") >= LEAST_SHARE * F.col("n")).alias("strong"), value.alias("value"))
             .filter(F.col("value") > LEAST_CHI_SQUARED).orderBy(F.desc("strong"), F.desc("value"), "h").limit(FEATURES)).collect()
    return Features.mined(np.array([r.h for r in found], np.int64).view(np.uint64), np.array([r.strong for r in found], bool))


@dataclass
class LabelModel:
    """P(toxic), and P(a voter fires | class, what its parent did); parent -1: none."""

    prior: float
    parent: np.ndarray
    chance: np.ndarray  # voter, class, parent's vote

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        given = np.where(self.parent >= 0, votes[:, self.parent], 0)
        out = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for j in range(votes.shape[1]):
            p = self.chance[j][:, given[:, j]]
            like = np.where(votes[:, j] == 1, np.log(p), np.log1p(-p))
            out += like[1] - like[0]
        return out

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(votes), -35, 35)))


def fit_label_model(votes: np.ndarray, free: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> LabelModel:
    """From vote patterns and how many unlabelled, clean and toxic documents show each."""
    n_voters = votes.shape[1]
    first = np.full((n_voters, 2, 2), 0.02)
    first[:, 1] = 0.3
    parent = np.full(n_voters, -1)
    for edges in range(n_voters):  # the strongest correlation first: until it is an edge, the class may be no more than that pair
        model = LabelModel(0.1, parent, first)
        if clean.sum() and toxic.sum():  # start from what the labelled ones show
            model = _maximised(votes, clean.astype(float), toxic.astype(float), model)
        model = _expected(votes, free, clean, toxic, model)
        q = model.posterior(votes)
        parent = _forest(votes, (free * (1 - q) + clean, free * q + toxic), edges + 1)
        if (parent >= 0).sum() <= edges:
            break
    return model


def _expected(votes, free, clean, toxic, model: LabelModel) -> LabelModel:
    for _ in range(ROUNDS):
        q = model.posterior(votes)
        model = _maximised(votes, free * (1 - q) + clean, free * q + toxic, model)
    return model


def _maximised(votes: np.ndarray, clean: np.ndarray, toxic: np.ndarray, model: LabelModel) -> LabelModel:
    chance = np.empty_like(model.chance)
    for y, weight in enumerate((clean, toxic)):
        for j, parent in enumerate(model.parent):
            for v in (0, 1):
                own = weight if parent < 0 else weight * (votes[:, parent] == v)
                chance[j, y, v] = (own @ votes[:, j] + 0.5 * (0.02, 0.3)[y]) / (own.sum() + 0.5)
    prior = (toxic.sum() + 0.1) / (toxic.sum() + clean.sum() + 1)
    return LabelModel(float(prior), model.parent, np.clip(chance, 1e-6, 1 - 1e-6))


def _forest(votes: np.ndarray, weights: tuple[np.ndarray, np.ndarray], edges: int) -> np.ndarray:
    """Parents in a forest of at most so many edges: the pairs that share most information within the classes, without circles."""
    n, total = votes.shape[1], sum(w.sum() for w in weights)
    shared = np.zeros((n, n))
    for w in weights:
        if not w.sum():
            continue
        one = (w @ votes) / w.sum()
        both = (votes * w[:, None]).T @ votes / w.sum()
        for a, b, joint in ((1, 1, both), (1, 0, one[:, None] - both), (0, 1, one[None] - both), (0, 0, 1 - one[:, None] - one[None] + both)):
            apart = np.outer(one if a else 1 - one, one if b else 1 - one)
            joint = np.maximum(joint, 1e-12)
            shared += w.sum() / total * joint * np.log(joint / np.maximum(apart, 1e-12))
    tree, near, left = list(range(n)), [[] for _ in range(n)], edges
    for value, i, j in sorted(((shared[i, j], i, j) for i in range(n) for j in range(i)), reverse=True):
        if left and value > LEAST_INFORMATION and tree[i] != tree[j]:
            tree = [tree[j] if t == tree[i] else t for t in tree]
            near[i].append(j)
            near[j].append(i)
            left -= 1
    parent, seen = np.full(n, -1), set()
    for root in range(n):
        open_ = [root] if root not in seen else []
        seen.update(open_)
        for i in open_:
            for j in near[i]:
                if j not in seen:
                    parent[j] = i
                    seen.add(j)
                    open_.append(j)
    return parent


@dataclass
class Model:
    features: Features
    label_model: LabelModel
    weights: np.ndarray  # the intercept first

    def score(self, seen: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(seen @ self.weights[1:] + self.weights[0], -35, 35)))


def _voted(docs: DataFrame, features: Features) -> DataFrame:
    """(doc_id, votes, bits) of every document, staged."""
    def measure(texts: pa.Array) -> list[pa.Array]:
        seen, votes = features.measure(texts)
        return [pa.array(votes, pa.int32()), pa.array([r.tobytes() for r in np.packbits(seen, axis=1)], pa.binary())]
    return staged(beside(docs, lambda: measure, "votes int, bits binary", ["doc_id"]).select("row.doc_id", "votes", "bits"), "votes")


def _pattern_counts(voted: DataFrame) -> np.ndarray:
    """How many documents show each of the 2**VOTERS patterns."""
    out = np.zeros(1 << VOTERS)
    for votes, n in voted.groupBy("votes").count().collect():  # at most 2**VOTERS rows
        out[votes] = n
    return out


def learnt_toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    sample = labelled_texts(docs, labels, max_labelled)
    features = mine(sample)
    voted = _voted(docs, features)
    known = sample.select("doc_id", "toxic")
    free = _pattern_counts(voted.join(known.select("doc_id").distinct(), "doc_id", "left_anti"))
    own = _voted(sample.select(F.struct("doc_id", "toxic").alias("doc_id"), "text"), features)
    clean, toxic = (_pattern_counts(own.filter(F.col("doc_id.toxic") == y)) for y in (0, 1))
    shown = np.flatnonzero(free + clean + toxic)
    votes = (shown[:, None] >> np.arange(VOTERS)) & 1
    label_model = fit_label_model(votes, free[shown], clean[shown], toxic[shown])
    table = np.zeros(1 << VOTERS, np.float32)
    table[shown] = label_model.posterior(votes)
    return Model(features, label_model, _fitted(voted, len(features.codes), table))


def _fitted(voted: DataFrame, n_features: int, table: np.ndarray) -> np.ndarray:
    """Logistic regression on the posterior label of every document, by Newton's method on sums made in Spark."""
    shared, weights = voted.sparkSession.sparkContext.broadcast(table), np.zeros(n_features + 1)
    tasks, ridge = voted.rdd.getNumPartitions(), np.full(n_features + 1, PENALTY)
    ridge[0] = 1e-6
    for _ in range(STEPS):
        now = weights.copy()

        def slopes(some: pa.RecordBatch) -> np.ndarray:
            packed = np.frombuffer(b"".join(some.column(1).to_pylist()), np.uint8).reshape(some.num_rows, -1)
            x = np.hstack([np.ones((some.num_rows, 1), np.float32), np.unpackbits(packed, axis=1, count=n_features).astype(np.float32)])
            p = 1 / (1 + np.exp(-np.clip(x @ now, -35, 35)))
            target = shared.value[some.column(0).to_numpy()]
            return np.concatenate([x.T @ (target - p), ((x * (p * (1 - p))[:, None].astype(np.float32)).T @ x).ravel().astype(np.float64)])

        total = summed(voted.select("votes", "bits"), slopes, tasks)
        if total is None:
            break
        n = len(weights)
        move = np.linalg.solve(total[n:].reshape(n, n) + np.diag(ridge), total[:n] - ridge * weights)
        weights += move * min(1.0, 4 / (np.abs(move).max() + 1e-12))
        if np.abs(move).max() < 1e-2:
            break
    return weights


def toxicity(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """``row`` and score, the chance that a document is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value

        def score(texts: pa.Array) -> list[pa.Array]:
            return [pa.array(own.score(own.features.measure(texts)[0]), pa.float64())]
        return score
    return beside(docs, make, "score double", carry)
