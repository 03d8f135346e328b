from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import public_tokenizers

from pyspark.sql import functions as F

from plantpulse.llm import language_id
from plantpulse.llm.language_id import MARK, UNKNOWN_LOG, VOCABULARY, expected_pieces, identify, learnt, learnt_groups, log_likelihoods, pieces
from plantpulse.llm.queries import op9_language_id
from tests.llm.conftest import awkward_texts, frame

KNOWN = pieces(public_tokenizers.path(VOCABULARY))
NUMBER = {n: i for i, n in enumerate(KNOWN.names)}
WORDS = ["straße", "the", "èreeau", "日本", "a", "x" * 40, "internationalisation", "ñandú"]


def segmentations(word: str):
    """All ways to cut a marked word into pieces or single characters."""
    text = MARK + word

    def go(i):
        if i == len(text):
            yield []
        for j in range(i + 1, len(text) + 1):
            if text[i:j] in NUMBER or j == i + 1:
                for rest in go(j):
                    yield [text[i:j], *rest]
    return go(0)


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(1)
    model = np.log(rng.random((KNOWN.size, 2)) / KNOWN.size)
    got = log_likelihoods(WORDS, KNOWN, model)
    for w, row in zip(WORDS, got):
        for language in range(2):
            @lru_cache(None)
            def total(i, text=MARK + w, language=language):
                if i == len(text):
                    return 1.0
                return sum(math.exp(model[NUMBER[text[i:j]], language] if text[i:j] in NUMBER else UNKNOWN_LOG) * total(j)
                           for j in range(i + 1, len(text) + 1) if text[i:j] in NUMBER or j == i + 1)
            assert abs(row[language] - math.log(total(0))) < 1e-8


def test_expected_counts():
    word = "therein"
    got = expected_pieces([word], KNOWN, np.ones((1, 1)))[0]
    want, total = np.zeros(KNOWN.size), 0.0
    for cut in segmentations(word):
        chance = math.prod((1 / 64) ** (1 if p in NUMBER else 2) for p in cut)
        total += chance
        for p in cut:
            if p in NUMBER:
                want[NUMBER[p]] += chance
    assert np.allclose(got, want / total)


def test_very_long_words_do_not_underflow():
    model = np.full((KNOWN.size, 1), -10.0)
    assert np.isfinite(log_likelihoods(["e" * 20_000], KNOWN, model)).all()


def test_awkward_texts(spark, awkward):
    texts = [(i, t) for i, t in enumerate(["der die und das ist nicht " * 5, "the and of this that with " * 5])]
    train = frame(spark, texts).selectExpr("text", "case doc_id when 0 then 'de' else 'en' end as lang")
    rows = identify(awkward, learnt(train)).collect()
    assert len(rows) == len(awkward_texts())
    for r in rows:
        letters = any(c.isalpha() for c in r["row"]["text"] or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1 and (letters or r.score == 0)


def test_nothing_learnt(spark, empty, awkward):
    model = learnt(empty)
    assert {r.lang_pred for r in identify(awkward, model).collect()} == {"und"}
    assert identify(empty, model).collect() == []


def test_any_number_of_languages(spark, awkward, monkeypatch):
    """Models of two languages each, one after the other, say what one model of all says."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("lang", F.concat("lang", F.pmod("doc_id", F.lit(2))))
    whole = learnt(docs)
    assert len(whole[0]) > 6
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 3)
    groups = learnt_groups(docs)
    assert [x for names, _ in groups for x in names] == whole[0] and len(groups) > 2
    for table in (docs.select("doc_id", "text"), awkward.select("doc_id", "text")):
        one, many = (sorted(((r["row"]["doc_id"], r.lang_pred, round(r.score, 9)) for r in identify(table, m, ["doc_id"]).collect()), key=repr) for m in (whole, groups))
        assert one == many


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang")
    rows = op9_language_id(spark, "/root/testdata/sf0.001").filter("held_out").join(docs, "doc_id").collect()
    assert len(rows) > 30 and sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
