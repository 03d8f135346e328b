from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from plantpulse.llm.substring_dedup import lengths, removals, substring_dedup, text_key
from tests.llm.conftest import awkward_texts, frame, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts: list[str | None], window: int) -> list[tuple[int, int, str]]:
    split = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i:i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = {i + k for i in range(len(w) - window + 1) if seen[tuple(w[i:i + window])] > 1 for k in range(window)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def found(docs, window: int):
    rows = docs.select("doc_id", "text", text_key().alias("k")).join(removals(docs, window).withColumnRenamed("key", "k"), "k")
    return Counter(tuple(r) for r in rows.select(
        "doc_id", "text", "n_words", "n_removed", "kept_text").collect())


def expected(texts, window: int):
    return Counter((i, t, *b) for (i, t), b in zip(texts, brute([t for _, t in texts], window)))


@pytest.mark.parametrize("window", [35, 12])
def test_awkward_texts(spark, awkward, window):
    assert found(awkward.select("doc_id", "text"), window) == expected(awkward_texts(), window)


@pytest.mark.parametrize("window", [2, 5, 80])
def test_random_repeats(spark, window):
    rng = random.Random(window)
    passages = [words(rng, 90, 500) for _ in range(3)]
    texts = []
    for i in range(40):
        own = words(rng, rng.randrange(120), 30 if i % 4 == 0 else 5000)
        cut = rng.randrange(len(own) + 1)
        piece = rng.choice(passages)[rng.randrange(40):rng.randrange(50, 90)] if i % 3 else []
        texts.append((i, " ".join([*own[:cut], *piece, *own[cut:]])))
    assert found(frame(spark, texts).select("doc_id", "text"), window) == expected(texts, window)


def test_documents_keep_their_columns(awkward):
    out = substring_dedup(awkward, 35)
    assert out.columns == awkward.columns
    got = Counter((r.doc_id, r.text) for r in out.collect())
    want = Counter((i, kept if gone else t) for (i, t), (_, gone, kept) in
                   zip(awkward_texts(), brute([t for _, t in awkward_texts()], 35)))
    assert got == want


def test_empty_table(empty):
    assert substring_dedup(empty).collect() == []


def test_lengths_double_up_to_the_window():
    assert lengths(35) == [18, 35] and lengths(100) == [25, 50, 100] and lengths(2) == [1, 2]
    with pytest.raises(ValueError):
        lengths(1)
