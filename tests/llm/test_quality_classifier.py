from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from plantpulse.llm.quality_classifier import (calibrate, classified, content, fit, labelled_sample, learnt_quality, quality_classifier,
                                               telling_words, telling_words_of, train)
from tests.llm.conftest import awkward_texts

SF = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


def test_accuracy_on_documents_not_learnt_from(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    learn = labels.filter("doc_id % 3 <> 0")
    rows = quality_classifier(docs, learn, ["doc_id"]).select("row.doc_id", "score", "kept").join(labels.filter("doc_id % 3 = 0"), "doc_id").collect()
    good = [r for r in rows if r.quality == 1 and r.toxic == 0]
    bad = [r for r in rows if not (r.quality == 1 and r.toxic == 0)]
    assert sum(r.kept for r in good) >= 0.95 * len(good) and sum(not r.kept for r in bad) >= 0.8 * len(bad)
    assert all(0 <= r.score <= 1 for r in rows)


def test_same_model_again(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    one, two = (learnt_quality(d, labels) for d in (docs, docs.repartition(5)))
    assert np.array_equal(one.words, two.words) and np.allclose(one.views[0].weights, two.views[0].weights)


def test_without_both_kinds_of_labels(spark, awkward, empty):
    for rows in ([], [(1, 1, 0)], [(1, None, None), (None, 0, 1)]):
        out = quality_classifier(awkward, spark.createDataFrame(rows, LABELS)).collect()
        assert len(out) == len(awkward_texts()) and all(r.kept and r.score is None for r in out)
    assert quality_classifier(empty, spark.createDataFrame([], LABELS)).collect() == []


def test_awkward_documents_are_scored(spark, awkward):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    out = classified(awkward, learnt_quality(docs, labels))
    assert out.schema["row"].dataType.names == awkward.columns
    assert all(0 <= r.score <= 1 for r in out.collect())


def test_views_teach_each_other():
    rng = np.random.default_rng(0)
    n = 3000
    label = rng.integers(0, 2, n)
    # each view is right by itself, but only 2000 documents are labelled
    text = [(np.array([y + rng.normal() * 0.02]), np.array([1], np.uint64)) for y in label]
    pages = np.stack([label + rng.normal(size=n) * 0.02], axis=1)
    shown = np.where(np.arange(n) < 2000, label, -1)
    model = train(text, pages, shown)
    assert sum(map(sum, model.given)) > 0
    score = model.score(np.stack([model.content_row(*t) for t in text]), pages)
    assert ((score > 0.5) == label)[2000:].mean() > 0.97


def test_useless_view_does_not_decide():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 300).astype(float)
    x = rng.normal(size=(300, 2))
    view = fit(x[:200], y[:200], 10.0)
    calibrate(view, x[200:], y[200:])
    assert np.abs(view.log_odds(x[200:])).max() < 2


def test_telling_words():
    lists = [np.array([1, 2, 3 if i < 30 else 4], np.uint64) for i in range(60)]
    assert set(telling_words(lists, np.array([1.0] * 30 + [0.0] * 30))) == {3, 4}


def test_every_unlabelled_document_can_be_given(spark):
    """Far more than any sample held: all that one view is sure of reach the other, once each."""
    from plantpulse.llm.quality_classifier import SparkPool, taught

    n, kind = 9000, "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, ("fine calm words here " if i % 3 else "dire loud shouts now ") + f"w{i}", "en", "good" if i % 3 else "bad", 20) for i in range(n)]
    docs = spark.createDataFrame(rows, kind).repartition(6)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(2000)] + [(n - 1, None, None)], LABELS)
    model = learnt_quality(docs, labels)
    assert [sum(x) for x in zip(*model.given)] == [n - 2000, n - 2000]
    pool = SparkPool(docs, labels, model.words)
    parts = [pool.rows(b.column(0)) for b in pool.table.toArrow().to_batches()]
    assert sum(len(t) for t, _ in parts) == n - 2000
    assert all((y >= 0).all() for p in parts for y in taught(p, [model.views]))


def test_pool_sums_are_those_of_its_rows(spark):
    from plantpulse.llm.quality_classifier import LocalPool, SparkPool, _moments, _slopes

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    model = learnt_quality(docs, labels)
    pool = SparkPool(docs.repartition(4), labels, model.words)
    near = LocalPool(pool.rows(pool.table.toArrow()["features"].combine_chunks()))
    for measures in ([_moments, _moments], [_slopes(v) for v in model.views]):
        for a, b in zip(pool.totals([model.views], measures), near.totals([model.views], measures)):
            assert np.allclose(a, b)


def _plain(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def _two_kinds(i: int, good: bool) -> tuple:
    return i, ("good calm text " if good else "$$$ ### loud ") * 20 + f"own{i}", "en", "s", 300


def test_labels_in_blocks_and_alternating(spark):
    for good in (lambda i: i % 2, lambda i: i % 4 == 3, lambda i: i < 80, lambda i: i >= 120):
        docs = _plain(spark, [_two_kinds(i, good(i)) for i in range(160)])
        labels = spark.createDataFrame([(i, int(good(i)), 0) for i in range(160)], LABELS)
        out = quality_classifier(docs, labels, ["doc_id"]).select("row.doc_id", "score", "kept").collect()
        assert len(out) == 160 and all(r.kept == bool(good(r.doc_id)) for r in out)


def test_too_few_to_keep_aside(spark):
    docs = _plain(spark, [_two_kinds(i, i > 2) for i in range(60)])
    labels = spark.createDataFrame([(i, int(i > 2), 0) for i in range(60)], LABELS)
    with pytest.warns(UserWarning, match="not calibrated"):
        model = learnt_quality(docs, labels)
    assert not model.calibrated and all(0 <= r.score <= 1 for r in classified(docs, model).collect())


def test_whole_of_a_long_labelled_text(spark):
    """The one telling word of a text of 100,000 different words counts wherever its hash stands."""
    filler = " ".join(f"w{i}" for i in range(100_000))
    docs = _plain(spark, [(i, (filler + " telling" if i < 6 else "telling short") if i % 2 else "other short", "en", "s", 9) for i in range(24)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(24)], LABELS)
    sample = labelled_sample(docs, labels)
    seen = {"aside": sample.filter("aside").count(), "all": sample.count()}
    assert seen == {"aside": 6, "all": 24}
    word = next(content(pa.array(["telling"])))[1][0]
    assert word in telling_words_of(sample)
    assert learnt_quality(docs, labels) is not None


def test_a_repeated_document_is_one_row_of_the_sample(spark):
    rows = [_two_kinds(i, i % 2) for i in range(40)] + [_two_kinds(1, True)] * 10_000
    docs = _plain(spark, rows)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] * 2 + [(1, 0, 0)], LABELS)
    sample = labelled_sample(docs, labels)
    assert sample.count() == 41 and sample.filter("doc_id = 1").count() == 2  # once with each of its labels
    assert labelled_sample(docs, labels, max_labelled=10).count() == 10
    assert quality_classifier(docs, labels, ["doc_id"]).count() == 10_040


def test_sums_in_two_levels(spark, monkeypatch):
    from plantpulse.llm import quality_classifier as module
    from plantpulse.llm.quality_classifier import SparkPool, _moments

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    model = learnt_quality(docs, labels)
    pool = SparkPool(docs, labels, model.words)
    pool.table = pool.table.repartition(7)
    one = pool.totals([model.views], [_moments, _moments])
    monkeypatch.setattr(module, "TASKS_TO_SUM", 2)
    pool.tasks = 7
    assert all(np.allclose(a, b) for a, b in zip(one, pool.totals([model.views], [_moments, _moments])))
