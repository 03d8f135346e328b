from __future__ import annotations

import random
import re

import pytest

from plantpulse.llm.components import components
from plantpulse.llm.jaccard_join import class_links, link_counts, near_duplicates
from tests.llm.conftest import awkward_texts, frame, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text: str | None, k: int) -> frozenset:
    w = WORD.findall(lowered(text or ""))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def brute(texts, percent: int = 80, shingle: int = 5):
    """(id, set size, smallest id of the group) by comparing all pairs."""
    sets = [shingles(t, shingle) for _, t in texts]
    group = list(range(len(texts)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                group[root(i)] = root(j)
    members: dict[int, list] = {}
    for i, (doc, _) in enumerate(texts):
        members.setdefault(root(i), []).append(doc)
    least = {r: min((d for d in m if d is not None), default=None) for r, m in members.items()}
    return sorted(((d, len(s), least[root(i)] if s else d) for i, ((d, _), s) in enumerate(zip(texts, sets))), key=repr)


def found(docs, **kw):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs, **kw).collect()), key=repr)


def test_awkward_texts(awkward):
    assert found(awkward) == brute(awkward_texts())
    assert found(awkward, percent=90, shingle=3) == brute(awkward_texts(), 90, 3)


@pytest.mark.parametrize("percent", [90, 60])
def test_chains_of_edits(spark, percent):
    rng = random.Random(percent)
    texts = []
    for group in range(6):
        text = words(rng, rng.randrange(30, 160), 4000)
        for _ in range(9):  # each copy is edited from the one before, so ends of a chain need not be alike
            texts.append((len(texts), " ".join(text)))
            text = list(text)
            for _ in range(rng.randrange(0, 3)):
                text[rng.randrange(len(text))] = f"e{rng.randrange(10 ** 6)}"
    texts += [(len(texts) + i, " ".join(words(rng, 40, 6))) for i in range(10)]
    assert found(frame(spark, texts), percent=percent) == brute(texts, percent)


def test_one_large_group_makes_no_pairs_within(spark):
    rng = random.Random(3)
    base = words(rng, 150, 9000)
    texts = [(i, " ".join([*base[:i % 150], f"edit{i}", *base[i % 150 + 1:]])) for i in range(400)]
    assert found(frame(spark, texts)) == [(i, 146, 0) for i in sorted(range(400), key=lambda i: repr((i, 146, 0)))]


def brute_links(texts, percent: int = 80, shingle: int = 5):
    sets = [shingles(t, shingle) for _, t in texts]
    n = [sum(i != j and bool(a) and bool(b) and 100 * len(a & b) >= percent * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    return sorted(((d, len(s), k) for (d, _), s, k in zip(texts, sets, n)), key=repr)


@pytest.mark.parametrize(("percent", "block"), [(90, 1000), (60, 3), (100, 2)])
def test_every_link_inside_groups(spark, monkeypatch, percent, block):
    monkeypatch.setattr("plantpulse.llm.jaccard_join.BLOCK", block)
    rng = random.Random(percent)
    texts = list(awkward_texts())
    for _ in range(4):
        text = words(rng, rng.randrange(20, 120), 4000)
        for _ in range(12):
            texts.append((100 + len(texts), " ".join(text)))
            text = list(text)
            for _ in range(rng.randrange(0, 3)):
                text[rng.randrange(len(text))] = f"e{rng.randrange(10 ** 6)}"
    docs = frame(spark, texts)
    assert sorted((tuple(r) for r in link_counts(docs, percent=percent).collect()), key=repr) == brute_links(texts, percent)
    assert found(docs, percent=percent) == brute(texts, percent)  # with blocks as small as these


def test_empty_table(empty):
    assert near_duplicates(empty).collect() == []
    assert [x.collect() for x in class_links(empty)] == [[], []] and link_counts(empty).collect() == []


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 300)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(301)}, 500: 500, 501: 500}
