"""Quality classifier by co-training of two views of a document.

One classifier sees the content (which of the telling words occur, and ratios of symbols, capitals,
repeats), the other the page's metadata (source, language, length). Both start from the same labelled
sample; each round, each gives the other all unlabelled documents it is sure of and has not yet given, with
its own verdict as label. On labelled documents kept aside, each view is calibrated (a line through its
log-odds); the combined log-odds are the sum of both less the prior they share.

Of the labelled documents a bounded sample of rows is used: at most ``MAX_LABELLED``, the first by a hash of doc_id, one for
each (doc_id, label). Every fourth of each label, by a second hash, is kept aside. The telling words are counted over the
whole texts of the rest in Spark; the driver gets their hashes and one row of fixed size per sampled document. All unlabelled
documents take part: their features (some 150 bytes each) are staged once, each step of a fit sums gradients and curvatures
over them in Spark, in two levels where there are many tasks, and the driver gets one sum of fixed size. Every document is
scored, whole.

Defined results: null labels are not used (the document counts as unlabelled); a document with both labels is learnt once with
each; of rows that repeat a labelled doc_id one stands for all, that with the smallest fingerprint; a label of which nothing
could be kept aside leaves the views uncalibrated, with a warning; without both kinds of label all documents are kept with
score null, with a warning; null or empty texts and null metadata are values of their own; texts of any length count whole;
repeated rows are scored one by one; an empty table gives no rows; the input's columns stay in ``row``.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plantpulse.llm import text_hash as th
from plantpulse.llm.mapping import beside
from plantpulse.llm.staging import staged

MAX_LABELLED = 6000
ROUNDS, SURE, PENALTIES = 3, 0.95, (30.0, 10.0)
USABLE = "doc_id is not null and quality is not null and toxic is not null"
POOL_ROWS, PIECES, TASKS_TO_SUM = 2000, 32, 256
TELLING_WORDS, LEAST_DOCUMENTS, LEAST_CHI_SQUARED = 400, 5, 6.6
ASIDE, SEED = 4, 20_011
KEEP_FROM = 0.5
_SOURCES, _LANGUAGES = 64, 16
_CLASSES = [np.isin(np.arange(256), list(chars)) for chars in (b"#*$%&<>", b"|", b"!", bytes(range(65, 91)), bytes(range(48, 58)), b"\n")]
N_RATIOS = len(_CLASSES) + 4


def content(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text (ratios, its different word hashes)."""
    for first, data, cuts in th.text_slices(texts):
        words = th.words_of(data, cuts, th.ALPHANUMERIC, first)
        size = np.maximum(np.diff(cuts), 1)
        shares = [np.diff(np.concatenate([[0], np.cumsum(kind[data])])[cuts]) / size for kind in _CLASSES]
        threes, bounds = th.runs(words.hashes, 3), words.bounds
        for d, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            own, n = np.unique(words.hashes[a:b]), b - a
            repeats = 1 - len(np.unique(threes[a:b - 2])) / (n - 2) if n > 2 else 0.0
            ratios = [*(s[d] for s in shares), np.log1p(n), len(own) / n if n else 0.0, repeats, (cuts[d + 1] - cuts[d]) / (n or 1)]
            yield np.array(ratios), own


def metadata(source: pa.Array, lang: pa.Array, n_chars: pa.Array) -> np.ndarray:
    """One row per document: hashed source and language, and length."""
    n = len(source)
    out = np.zeros((n, _SOURCES + _LANGUAGES + 2), np.float64)
    for column, width, at in ((source, _SOURCES, 0), (lang, _LANGUAGES, _SOURCES)):
        data = column.cast(pa.large_string()).to_pylist()
        place = {v: int(th.mix(np.frombuffer(_eight(v), np.uint64)).sum() % np.uint64(width)) for v in set(data)}
        out[np.arange(n), [at + place[v] for v in data]] = 1
    length = n_chars.cast(pa.float64()).to_numpy(zero_copy_only=False)
    out[:, -2] = np.log1p(np.maximum(np.nan_to_num(length), 0))
    out[:, -1] = np.isnan(length)
    return out


def _eight(value: str | None) -> bytes:
    raw = b"\x00" if value is None else b"\x01" + value.encode()
    return raw + bytes(-len(raw) % 8)


@dataclass
class View:
    """A logistic regression on scaled columns, and its calibration."""

    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.center) / self.scale) @ self.weights[1:] + self.weights[0]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.raw(x) + self.shift


def _newton(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 12) -> np.ndarray:
    design, w = np.hstack([np.ones((len(x), 1)), x]), np.zeros(x.shape[1] + 1)
    ridge = np.full(len(w), penalty)
    ridge[0] = 1e-6
    for _ in range(steps):
        p = _chance(design @ w)
        slope = design.T @ (y - p) - ridge * w
        move = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.diag(ridge), slope)
        w += move * min(1.0, 8 / (np.abs(move).max() + 1e-12))
        if np.abs(move).max() < 1e-6:
            break
    return w


def _chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, penalty: float) -> View:
    center, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    return View(center, scale, _newton((x - center) / scale, y, penalty))


def calibrate(view: View, x: np.ndarray, y: np.ndarray) -> None:
    view.shift, view.slope = _newton(view.raw(x)[:, None], y, 1.0)
    if view.slope < 0:  # worse than chance on what was kept aside: the prior alone
        view.slope, view.shift = 0.0, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))


@dataclass
class Model:
    words: np.ndarray  # sorted hashes of the telling words
    views: tuple[View, View]
    prior: float  # log-odds
    given: list[tuple[int, int]] = field(default_factory=list)  # by round, to the content and the metadata view
    calibrated: bool = True

    def content_row(self, ratios: np.ndarray, own: np.ndarray) -> np.ndarray:
        return np.concatenate([ratios, np.isin(self.words, own, assume_unique=True)])

    def score(self, text_rows: np.ndarray, page_rows: np.ndarray) -> np.ndarray:
        a, b = self.views
        return _chance(a.log_odds(text_rows) + b.log_odds(page_rows) - self.prior)


def telling_words(lists: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    """Words whose presence differs most between the labels (chi-squared), in enough documents."""
    words = np.concatenate(lists)
    label = np.repeat(good, [len(x) for x in lists])
    known, at, count = np.unique(words, return_inverse=True, return_counts=True)
    in_good = np.bincount(at, weights=label, minlength=len(known))
    n, n_good = len(lists), good.sum()
    expected = count * n_good / n
    spread = expected * (1 - n_good / n) * (1 - count / n) + 1e-9
    value = np.where(count >= LEAST_DOCUMENTS, (in_good - expected) ** 2 / spread, -1.0)
    best = np.argsort(-value, kind="stable")[:TELLING_WORDS]
    return np.sort(known[best[value[best] > LEAST_CHI_SQUARED]])


def telling_words_of(sample: DataFrame) -> np.ndarray:
    """The same for the rows of a sample that are not kept aside, counted in Spark over their whole texts."""
    base = sample.filter("not aside")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = batch.column(1).to_numpy(zero_copy_only=False)
            for d, (_, own) in enumerate(content(batch.column(0))):
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(np.full(len(own), good[d]), pa.int32())], names=["h", "good"])

    n, n_good = base.agg(F.count("*"), F.coalesce(F.sum("good"), F.lit(0))).first()
    expected = F.col("n") * (n_good / max(n, 1))
    spread = expected * (1 - n_good / max(n, 1)) * (1 - F.col("n") / max(n, 1)) + 1e-9
    found = (base.select("text", "good").mapInArrow(count, "h long, good int").groupBy("h").agg(F.count("*").alias("n"), F.sum("good").alias("in_good"))
             .filter(F.col("n") >= LEAST_DOCUMENTS).select("h", ((F.col("in_good") - expected) ** 2 / spread).alias("value"))
             .filter(F.col("value") > LEAST_CHI_SQUARED).orderBy(F.desc("value"), "h").limit(TELLING_WORDS))
    return np.sort(np.array([r.h for r in found.collect()], np.int64).view(np.uint64))


Rows = tuple[np.ndarray, np.ndarray]  # of the content and the metadata view


def taught(rows: Rows, history: list[tuple[View, View]]) -> list[np.ndarray]:
    """Labels that the rounds so far have given the content and the metadata view for these documents, -1 for none."""
    out = []
    for me in (1, 0):
        given = np.full(len(rows[me]), -1)
        for views in history:
            chance = _chance(views[me].raw(rows[me]))
            sure = (given < 0) & (np.maximum(chance, 1 - chance) >= SURE)
            given[sure] = chance[sure] >= 0.5
        out.append(given)
    return out


def _moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])


def _slopes(view: View):
    """Gradient and curvature of the log-likelihood at the view's weights, as one vector."""
    def run(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        design = np.hstack([np.ones((len(x), 1)), (x - view.center) / view.scale])
        p = _chance(design @ view.weights)
        return np.concatenate([design.T @ (y - p), ((design * (p * (1 - p))[:, None]).T @ design).ravel()])
    return run


class LocalPool:
    """Unlabelled documents, and sums over those that were given a label."""

    def __init__(self, rows: Rows):
        self.rows = rows

    def totals(self, history: list[tuple[View, View]], measures: list) -> list[np.ndarray]:
        return [m(x[y >= 0], y[y >= 0]) for m, x, y in zip(measures, self.rows, taught(self.rows, history))]


def measured(source: DataFrame, words: np.ndarray, keys: list[str]) -> DataFrame:
    """The keys and ``features``: both views of a document's whole text and metadata in some 150 bytes."""
    model = Model(words, (None, None), 0.0)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, POOL_ROWS):
                some = batch.slice(first, POOL_ROWS)
                text = np.stack([model.content_row(*t) for t in content(some.column(0))])
                page = metadata(some.column(1), some.column(2), some.column(3))
                packed = np.hstack([
                    np.ascontiguousarray(text[:, :N_RATIOS]).view(np.uint8), np.packbits(text[:, N_RATIOS:] > 0, axis=1),
                    page[:, :_SOURCES].argmax(axis=1)[:, None].astype(np.uint8), page[:, _SOURCES:-2].argmax(axis=1)[:, None].astype(np.uint8),
                    np.ascontiguousarray(page[:, -2:]).view(np.uint8)])
                yield pa.RecordBatch.from_arrays([*some.columns[4:], pa.array([r.tobytes() for r in packed], pa.binary())], names=[*keys, "features"])

    kinds = "".join(f"{k} {source.schema[k].dataType.simpleString()}, " for k in keys)
    return source.select("text", "source", "lang", F.col("n_chars").cast("double").alias("n_chars"), *keys).mapInArrow(measure, f"{kinds}features binary")


def unpacked(features: pa.Array, n_words: int) -> Rows:
    data = np.frombuffer(b"".join(features.to_pylist()), np.uint8).reshape(len(features), -1)
    bits = N_RATIOS * 8 + -(-n_words // 8)
    text = np.hstack([np.ascontiguousarray(data[:, :N_RATIOS * 8]).view(np.float64),
                      np.unpackbits(data[:, N_RATIOS * 8:bits], axis=1, count=n_words)])
    page = np.zeros((len(data), _SOURCES + _LANGUAGES + 2))
    page[np.arange(len(data)), data[:, bits]] = 1
    page[np.arange(len(data)), _SOURCES + data[:, bits + 1].astype(np.int64)] = 1
    page[:, -2:] = np.ascontiguousarray(data[:, bits + 2:]).view(np.float64)
    return text, page


class SparkPool:
    """The same over all rows of ``docs`` without a label: their features are staged, only sums come to the driver."""

    def __init__(self, docs: DataFrame, labels: DataFrame, words: np.ndarray):
        self.n_words = len(words)
        known = labels.filter(USABLE).select("doc_id").distinct()
        self.table = staged(measured(docs, words, ["doc_id"]).join(known, "doc_id", "left_anti").select("features"), "unlabelled")
        self.tasks = self.table.rdd.getNumPartitions()

    def rows(self, features: pa.Array) -> Rows:
        return unpacked(features, self.n_words)

    def totals(self, history: list[tuple[View, View]], measures: list) -> list[np.ndarray]:
        n_words = self.n_words
        nothing = (np.empty((0, N_RATIOS + n_words)), np.empty((0, _SOURCES + _LANGUAGES + 2)))
        empty = [m(x, np.empty(0)) for m, x in zip(measures, nothing)]
        whole = summed(self.table, lambda some: np.concatenate(LocalPool(unpacked(some.column(0), n_words)).totals(history, measures)), self.tasks)
        return empty if whole is None else np.split(whole, [len(empty[0])])


def summed(table: DataFrame, measure: Callable[[pa.RecordBatch], np.ndarray], tasks: int) -> np.ndarray | None:
    """The sum of what ``measure`` makes of a table's batches, vectors of one size; None without rows."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for first in range(0, batch.num_rows, POOL_ROWS):
                found = measure(batch.slice(first, POOL_ROWS))
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(PIECES), pa.int32()), pa.array([TaskContext.get().partitionId() // TASKS_TO_SUM] * PIECES, pa.int32()),
                 pa.array([x.tobytes() for x in np.array_split(total, PIECES)], pa.binary())], names=["piece", "tasks", "total"])

    def merged(some: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.float64) for x in some["total"].to_pylist())
        return pa.table({"piece": some["piece"].slice(0, 1), "tasks": some["tasks"].slice(0, 1), "total": pa.array([total.tobytes()], pa.binary())})

    kind = "piece int, tasks int, total binary"
    sums = table.mapInArrow(add, kind)
    if tasks > TASKS_TO_SUM:  # no group sees more than so many rows, then one for each of their groups
        sums = sums.groupBy("piece", "tasks").applyInArrow(merged, kind)
    found = sums.groupBy("piece").applyInArrow(merged, kind).toArrow()
    return np.concatenate([np.frombuffer(x, np.float64) for x in found.sort_by("piece")["total"].to_pylist()]) if len(found) else None


def refit(views: tuple[View, View], base: list[tuple[np.ndarray, np.ndarray]], pool, history: list[tuple[View, View]], moments: list[np.ndarray],
          steps: int = 12) -> tuple[View, View]:
    """Newton's method on the labelled rows and sums over the pool, from the views before.

    However many documents the pool gives, together they weigh no more than the labelled ones.
    """
    now, shares = [], []
    for view, (x, y), far in zip(views, base, moments):
        shares.append(min(1.0, len(x) / max(far[0], 1)))
        both = _moments(x, y) + shares[-1] * far
        center, square = np.split(both[1:] / both[0], 2)
        scale = np.sqrt(np.maximum(square - center ** 2, 0))
        scale[scale < 1e-6] = 1.0
        weights = view.weights[1:] / view.scale
        now.append(View(center, scale, np.concatenate([[view.weights[0] + weights @ (center - view.center)], weights * scale])))
    for _ in range(steps):
        measures, largest = [_slopes(v) for v in now], 0.0
        for view, penalty, measure, (x, y), share, far in zip(now, PENALTIES, measures, base, shares, pool.totals(history, measures)):
            n = len(view.weights)
            both, ridge = measure(x, y) + share * far, np.full(n, penalty)
            ridge[0] = 1e-6
            move = np.linalg.solve(both[n:].reshape(n, n) + np.diag(ridge), both[:n] - ridge * view.weights)
            view.weights = view.weights + move * min(1.0, 8 / (np.abs(move).max() + 1e-12))
            largest = max(largest, float(np.abs(move).max()))
        if largest < 1e-3:  # the next step would be of the order of its square
            break
    return now[0], now[1]


def kept_aside(label: np.ndarray) -> np.ndarray:
    """Places of every fourth document of each label, in the order of a mixed hash of their place."""
    mixed = th.mix(np.arange(len(label), dtype=np.uint64) + np.uint64(SEED))
    return np.sort(np.concatenate([own[np.argsort(mixed[own])][ASIDE - 1::ASIDE] for own in (np.flatnonzero(label == v) for v in (0, 1))]))


def train(text: list[tuple[np.ndarray, np.ndarray]], pages: np.ndarray, label: np.ndarray, rounds: int = ROUNDS) -> Model | None:
    """On documents at hand; label: 1 good, 0 bad, -1 unlabelled. Every fourth of each label is kept aside to calibrate."""
    aside, labelled, free = kept_aside(label), np.flatnonzero(label >= 0), np.flatnonzero(label < 0)
    base = np.setdiff1d(labelled, aside)
    if len({*label[base]}) < 2:
        return None
    words = telling_words([text[i][1] for i in base], label[base].astype(float))
    own = Model(words, (None, None), 0.0)
    rows = (np.stack([own.content_row(*t) for t in text]), pages)
    return co_train(words, [x[base] for x in rows], label[base], [x[aside] for x in rows], label[aside], LocalPool((rows[0][free], rows[1][free])), rounds)


def co_train(words: np.ndarray, rows: list[np.ndarray], label: np.ndarray, aside: list[np.ndarray], truth: np.ndarray, pool, rounds: int = ROUNDS) -> Model:
    """Rows of both views to learn from and to calibrate on, and a pool of unlabelled documents."""
    model = Model(words, (None, None), 0.0)
    own = [(x, label.astype(float)) for x in rows]
    views = tuple(fit(x, y, p) for (x, y), p in zip(own, PENALTIES))
    history: list[tuple[View, View]] = []
    before = [0, 0]
    for _ in range(rounds):
        history.append(views)
        moments = pool.totals(history, [_moments, _moments])
        given = [int(m[0]) for m in moments]
        model.given.append((given[0] - before[0], given[1] - before[1]))
        if given == before:
            break
        views, before = refit(views, own, pool, history, moments), given
    model.views, model.calibrated = (views[0], views[1]), len({*truth}) == 2
    shown = truth if model.calibrated else label
    model.prior = float(np.log((shown.sum() + 1) / (len(shown) - shown.sum() + 1)))
    if model.calibrated:
        for view, x in zip(views, aside):
            calibrate(view, x, truth.astype(float))
    else:
        warnings.warn("too few documents of one label to keep some aside: the views are not calibrated", stacklevel=2)
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, good, aside, text, source, lang, n_chars) of at most ``max_labelled`` rows, staged: one for each (doc_id, label)."""
    wanted = (labels.filter(USABLE)
              .select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int").alias("good")).distinct()
              .orderBy(F.xxhash64("doc_id"), "doc_id", "good").limit(max_labelled))
    turn = Window.partitionBy("good").orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id")  # over a bounded number of rows
    wanted = staged(wanted.withColumn("aside", F.row_number().over(turn) % ASIDE == 0), "wanted")
    row = F.struct("text", "source", "lang", F.col("n_chars").cast("double").alias("n_chars"))
    print_of = F.xxhash64("text", "source", "lang", "n_chars")
    least = docs.select("doc_id", print_of.alias("fingerprint")).join(wanted, "doc_id").groupBy("doc_id").agg(F.min("fingerprint").alias("fingerprint"))
    one = docs.select("doc_id", print_of.alias("fingerprint"), row.alias("row")).join(staged(least, "chosen"), ["doc_id", "fingerprint"])
    once = one.groupBy("doc_id").agg(F.first("row").alias("row"))
    return staged(once.join(wanted, "doc_id").select("doc_id", "good", "aside", "row.*"), "labelled")


def learnt_quality(docs: DataFrame, labels: DataFrame, **bounds: int) -> Model | None:
    sample = labelled_sample(docs, labels, **bounds)
    if sample.filter("not aside").select("good").distinct().count() < 2:
        warnings.warn("labels of one kind only: no classifier, every document is kept", stacklevel=2)
        return None
    words = telling_words_of(sample)
    found = measured(sample, words, ["doc_id", "good", "aside"]).toArrow().sort_by([("doc_id", "ascending"), ("good", "ascending")])
    rows, label = unpacked(found["features"].combine_chunks(), len(words)), found["good"].to_numpy()
    aside = found["aside"].to_numpy()
    return co_train(words, [x[~aside] for x in rows], label[~aside], [x[aside] for x in rows], label[aside], SparkPool(docs, labels, words))


def classified(docs: DataFrame, model: Model | None, carry: list[str] | None = None, keep_from: float = KEEP_FROM) -> DataFrame:
    """``row``, score (chance that the document is good) and kept."""
    carried = docs.columns if carry is None else carry
    shared = docs.sparkSession.sparkContext.broadcast(model)
    packed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in carried)).alias("kept_row"),
        F.struct("text", "source", "lang", F.col("n_chars").cast("double").alias("n_chars")).alias("value"))

    def make():
        own = shared.value

        def score(values: pa.Array) -> list[pa.Array]:
            if own is None:
                return [pa.nulls(len(values), pa.float64()), pa.array([True] * len(values), pa.bool_())]
            text, source, lang, n_chars = (values.field(i) for i in range(4))
            found = own.score(np.stack([own.content_row(*t) for t in content(text)]), metadata(source, lang, n_chars))
            return [pa.array(found), pa.array(found >= keep_from)]
        return score
    return beside(packed, make, "score double, kept boolean", ["kept_row"], text="value").select(
        F.col("row.kept_row").alias("row"), "score", "kept")


def quality_classifier(docs: DataFrame, labels: DataFrame, carry: list[str] | None = None) -> DataFrame:
    return classified(docs, learnt_quality(docs, labels), carry)
