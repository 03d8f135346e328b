"""Voters against plain Python, the label model on votes of known origin, and the whole query on held-out documents."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

from plantpulse.llm.queries import op13_toxicity
from plantpulse.llm.toxicity import LEXICONS, MINED, VOTERS, Features, fit_label_model, labelled_texts, learnt_toxicity, mine, toxicity
from tests.llm.conftest import awkward_texts

LABELS = "doc_id long, quality int, toxic int"


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = op13_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id", "left").collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    seen = [r for r in rows if r.held_out and r.toxic is not None]
    assert sum(r.predicted == r.toxic for r in seen) >= 0.95 * len(seen)
    assert sum(r.predicted for r in seen if r.toxic == 0) == 0
    assert sum(r.predicted for r in seen if r.toxic == 1) >= 0.6 * sum(r.toxic for r in seen)


def test_words_and_beginnings_are_mined(spark):
    """Only a family of beginnings tells the classes apart; endings never repeat."""
    rows = [(i, f"calm text number w{i} with {'grimba' if i % 4 == 0 else 'grace'}{i} inside", "en", "s", 9) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(0, 400, 3)], LABELS)
    out = toxicity(docs, learnt_toxicity(docs, labels), ["doc_id"]).select("row.doc_id", "score").collect()
    assert all((r.score >= 0.5) == (r.doc_id % 4 == 0) for r in out)


def test_voters():
    texts = ["an idiot here", "You are so PATHETIC", "ONLY CAPITALS STAND IN THIS LOUD TEXT", "no!!!! stop!!!! now!!!! ever!!!!", "what an 1d10t", None, "",
             "plain words", "scum " * 3000, "sc\num", "you one two three four scum"]
    found = Features.mined(np.empty(0, np.uint64), np.empty(0, bool))
    _, votes = found.measure(pa.array(texts, pa.string()))
    for text, vote in zip(texts, votes):
        words = re.findall(r"[0-9a-z]+", (text or "").lower())
        for k, own in enumerate(LEXICONS):
            assert (vote >> k) & 1 == bool(set(words) & set(own))
    k = len(LEXICONS)
    assert [(v >> k) & 1 for v in votes] == [0, 0, 1] + [0] * 8
    assert [(v >> (k + 1)) & 1 for v in votes] == [0, 0, 0, 1] + [0] * 7
    assert [(v >> (k + 2)) & 1 for v in votes] == [0, 0, 0, 0, 1] + [0] * 6
    assert [(v >> (k + 3)) & 1 for v in votes] == [0, 1] + [0] * 9


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(3)
    n = 40_000
    y = rng.random(n) < 0.15
    hit = lambda p, q: rng.random(n) < np.where(y, p, q)
    votes = np.stack([hit(0.8, 0.05), hit(0.7, 0.02), hit(0.6, 0.1), hit(0.75, 0.03), hit(0.5, 0.5)], axis=1)
    copy = np.where(rng.random(n) < 0.95, votes[:, 2], hit(0.6, 0.1))  # repeats the third voter
    votes = np.hstack([votes, copy[:, None]]).astype(int)
    pattern = votes @ (1 << np.arange(6))
    free = np.bincount(pattern, minlength=64).astype(float)
    every = (np.arange(64)[:, None] >> np.arange(6)) & 1
    model = fit_label_model(every, free, np.zeros(64), np.zeros(64))
    assert model.parent[5] == 2 or model.parent[2] == 5
    assert sum(p >= 0 for p in model.parent) == 1
    for j, (p, q) in enumerate([(0.8, 0.05), (0.7, 0.02), (None, None), (0.75, 0.03), (0.5, 0.5)]):
        if p and model.parent[j] < 0:
            assert abs(model.chance[j, 1, 0] - p) < 0.05 and abs(model.chance[j, 0, 0] - q) < 0.03
    assert abs(model.prior - 0.15) < 0.02
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.95


def test_awkward_documents_and_no_labels(spark, awkward, empty):
    for rows in ([], [(1, 1, 0)], [(1, None, None), (None, 0, 1)], [(20, 0, 1), (20, 0, 1), (21, 1, 0), (7, 0, 1), (7, 0, 0)]):
        model = learnt_toxicity(awkward, spark.createDataFrame(rows, LABELS))
        out = toxicity(awkward, model)
        assert out.schema["row"].dataType.names == awkward.columns
        found = out.collect()
        assert len(found) == len(awkward_texts()) and all(0 <= r.score <= 1 for r in found)
    assert toxicity(empty, learnt_toxicity(empty, spark.createDataFrame([], LABELS))).collect() == []


def test_lexicons_alone_without_labels(spark):
    rows = [(i, "you are an idiot and a loser, pathetic scum" if i % 10 == 0 else f"fine words number {i}", "en", "s", 9) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = toxicity(docs, learnt_toxicity(docs, spark.createDataFrame([], LABELS)), ["doc_id"]).select("row.doc_id", "score").collect()
    assert all((r.score >= 0.5) == (r.doc_id % 10 == 0) for r in out)


def test_the_sample_is_bounded_by_rows(spark, awkward):
    labels = spark.createDataFrame([(20, 0, 1)] * 5000 + [(i, 1, 0) for i in range(1, 20)], LABELS)
    assert labelled_texts(awkward, labels).filter("doc_id = 20").count() == 1
    assert labelled_texts(awkward, labels, 4).count() == 4
    assert len(mine(labelled_texts(awkward, labels)).voter) >= 0 and VOTERS == len(LEXICONS) + 4 + MINED
