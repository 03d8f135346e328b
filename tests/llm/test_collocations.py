"""Phrases against plain counting, and the quicksort against a counter."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from plantpulse.llm import collocations as module
from plantpulse.llm.collocations import Bitmap, collocations, quicksort_counts
from tests.llm.conftest import SCHEMA, awkward_texts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top):
    count, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            count.update((lang, *words[i:i + m]) for m in range(1, 5) for i in range(len(words) - m + 1))
    found = {p: a for p, a in count.items() if a >= least and len(p) > 2}
    out = []
    for (lang, *p), a in found.items():
        longer = [b for (other, *q), b in found.items() if other == lang and len(q) > len(p)
                  and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if any(100 * b >= 80 * a for b in longer):
            continue
        cuts = [(2_000_000 * a // (count[(lang, *p[:k])] + count[(lang, *p[k:])]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(p).encode(), count[(lang, *p[:k])], count[(lang, *p[k:])]))
    result = []
    for lang in n:
        for rank, (_, s, a, phrase, left, right) in enumerate(sorted(x for x in out if x[0] == lang)[:top], 1):
            result.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -s))
    return sorted(result)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def tables():
    rng = random.Random(5)
    common = [f"c{i}" for i in range(12)]
    texts = [(" ".join(rng.choice(common) if rng.random() < 0.7 else f"r{rng.randrange(4000)}" for _ in range(rng.randrange(1, 120))) + rng.choice(["", ".", "! Next, c1 c2"]),
              rng.choice(["en", "de", None, "und"])) for _ in range(400)]
    texts += [("Very Common pair " + " ".join(f"t{rng.randrange(300)} very common" for _ in range(40)), "en") for _ in range(60)]
    texts += [("one fixed passage of words", "fr")] * 700 + [(None, "en"), ("", None), (" \t", "en"), ("a\tb a\x0bb", "xx")] + [("é É straße", "de")] * 40
    return texts + [(t, "en" if k % 2 else None) for k, (_, t) in enumerate(awkward_texts())]


def documents(spark, texts):
    return spark.createDataFrame([(i, t, lang, "s", 1, 0, 0, 0, 0) for i, (t, lang) in enumerate(texts)], SCHEMA).repartition(5)


@pytest.mark.parametrize("least, top", [(30, 2000), (30, 7), (3, 50)])
def test_phrases(spark, least, top):
    texts = tables()
    assert rows_of(collocations(documents(spark, texts), least, top)) == brute(texts, least, top)


def test_hot_pairs_are_split(spark, monkeypatch):
    """Small tasks: the common pair is over its share, so its suffixes go to many tasks and counts are added up."""
    monkeypatch.setattr(module, "SUFFIXES_PER_TASK", 300)
    texts = tables()
    assert rows_of(collocations(documents(spark, texts))) == brute(texts, 30, 2000)


def test_scores_beyond_64_bits(spark):
    """Counts whose product with the scale needs more than 64 bits."""
    a = 9_000_000_000_000_000_000
    phrases = spark.createDataFrame([(1, 2, None, None, a)], "w1 long, w2 long, w3 long, w4 long, a long")
    words = spark.createDataFrame([(1, 5, a), (2, 5, a)], "w1 long, g long, n long")
    assert [(r.score, r.k) for r in module.scored(phrases, words).collect()] == [(1_000_000, 1)]


def test_empty_tables(spark, empty):
    assert collocations(empty).collect() == []
    assert collocations(documents(spark, [(None, None), ("a b", "en")])).collect() == []


def test_quicksort():
    rng = np.random.default_rng(1)
    keys = [rng.integers(0, 6, 3000).astype(np.uint64) for _ in range(3)]
    keys[0] += np.uint64(1)
    keys[2][keys[1] == 0] = 0
    weight = rng.integers(1, 4, 3000)
    whole = np.ones(3000, bool)
    for least in (1, 30, 10_000):
        want = Counter()
        for row, w in zip(zip(*keys), weight):
            for d in range(3):
                if row[d] == 0:
                    break
                want[row[:d + 1]] += int(w)
        got = {tuple(k[r] for k in keys[:d + 1]): int(a) for d, rows, heavy in quicksort_counts(keys, weight, whole, least) for r, a in zip(rows, heavy)}
        assert got == {p: a for p, a in want.items() if a >= least}
    parts = list(quicksort_counts(keys, weight, ~whole, 10_000))
    assert sum(len(rows) for _, rows, _ in parts) == len({p for p in want})  # parts of counts are never abandoned


def test_bitmap(spark):
    values = np.random.default_rng(2).integers(-2**63, 2**63 - 1, 5000)
    found = Bitmap(spark.createDataFrame([(int(v),) for v in values], "h long"), "h")
    assert found.may_hold(values.view(np.uint64)).all()
    assert found.may_hold(np.random.default_rng(3).integers(0, 2**63, 5000).view(np.uint64)).mean() < 0.1
    assert not Bitmap(spark.createDataFrame([], "h long"), "h").may_hold(values.view(np.uint64)).any()
