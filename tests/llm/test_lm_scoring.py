from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from plantpulse.llm import lm_scoring, queries
from plantpulse.llm.lm_scoring import lm_scores, lm_scores_joined
from tests.llm.conftest import awkward_texts, frame, words

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(w, n):
    return Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1))


def brute(texts, order):
    split = [WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) for _, t in texts]
    total = {n: sum((grams(w, n) for w in split), Counter()) for n in range(1, order + 1)}
    everything, out = sum(map(len, split)), []
    for (doc, _), w in zip(texts, split):
        own, score = {n: grams(w, n) for n in range(1, order + 1)}, 0.0
        left = everything - len(w)

        def count(g):
            return total[len(g)][g] - own[len(g)][g] if g else left
        for i in range(len(w)):
            most = min(order, i + 1)
            for n in range(most, 0, -1):
                g = tuple(w[i - n + 1:i + 1])
                if count(g) > 0:
                    score += math.log(count(g) / count(g[:-1])) + (most - n) * math.log(0.4)
                    break
            else:
                score += (most - 1) * math.log(0.4) - math.log(left + 1)
        out.append((doc, len(w), round(score, 5)))
    return sorted(out, key=repr)


def found(docs, how=lm_scores, **kw):
    rows = how(docs, ["doc_id"], **kw).collect()
    return sorted(((r["row"]["doc_id"], r.n_words, round(r.log_score, 5)) for r in rows), key=repr)


def close(got, want):
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(g[2] - w[2]) < 1e-3 for g, w in zip(got, want))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_brute_force(spark, monkeypatch, order):
    monkeypatch.setattr(lm_scoring, "CHUNK_DOCS", 7)
    rng = random.Random(order)
    texts = awkward_texts() + [(400 + i, " ".join(words(rng, rng.randrange(40), 25))) for i in range(40)]
    close(found(frame(spark, texts).repartition(4), order=order), brute(texts, order))


def test_one_document(spark):
    close(found(frame(spark, [(1, "a b a b")]), order=2), brute([(1, "a b a b")], 2))


def test_columns_stay(awkward):
    assert lm_scores(awkward).schema["row"].dataType.names == awkward.columns


def test_empty_table(empty):
    assert lm_scores(empty).collect() == []
    assert lm_scores_joined(empty).collect() == []


@pytest.mark.parametrize("order", [1, 3])
def test_joined_form_gives_the_same(spark, order):
    rng = random.Random(order)
    texts = awkward_texts() + [(400 + i, " ".join(words(rng, rng.randrange(40), 12))) for i in range(40)]
    close(found(frame(spark, texts).repartition(4), lm_scores_joined, order=order), brute(texts, order))


def test_query_scores_by_trigrams(spark):
    assert [q for q in queries.queries() if q.startswith("op8")] == ["op8_lm_scoring"]
    ask = queries.queries()["op8_lm_scoring"]
    got = [(r.doc_id, r.n_words, r.log_score) for r in ask(spark, SF).collect()]
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    close(sorted(got, key=repr), brute(texts, 3))


@pytest.mark.parametrize("order", [3, 4])
def test_sifted_orders_lose_no_count(spark, monkeypatch, order):
    monkeypatch.setattr(lm_scoring, "CHUNK_DOCS", 3)
    rng = random.Random(order)
    texts = [(i, " ".join(words(rng, rng.randrange(60), 6))) for i in range(30)]
    texts += [(100, "only here only here only here only"), (101, "a far pair"), (102, "far pair b"), (103, "a far pair b")]
    close(found(frame(spark, texts).repartition(5), order=order), brute(texts, order))
