from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantpulse.llm import decontamination
from plantpulse.llm.decontamination import decontaminate, n_hit, winnowed
from tests.llm.conftest import awkward_texts, frame, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts, items, window=10):
    out = []
    for doc, text in texts:
        w, hit, ids = split(text), set(), set()
        for item, content in items:
            v = split(content)
            n = min(window, len(v))
            wanted = {tuple(v[i:i + n]) for i in range(len(v) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in wanted:
                    hit |= set(range(i, i + n))
                    ids.add("" if item is None else str(item))
        out.append((doc, len(w), len(hit), tuple(sorted(ids))))
    return Counter(out)


def found(docs, bench, **kw):
    rows = decontaminate(docs, bench, ["doc_id"], **kw).select("row.doc_id", "n_words", n_hit().alias("n_hit"), "items")
    return Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in rows.collect())


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(11)
    items = [(k, " ".join(words(rng, n, 300))) for k, n in enumerate([30, 10, 11, 9, 3, 1, 25, 40])]
    items += [(8, None), (9, ""), (9, "..."), (None, " ".join(words(rng, 14, 300))), (3, " ".join(words(rng, 12, 300))),
              (12, "again " * 20)]
    texts = awkward_texts() + [(200, "again " * 40), (201, "again " * 9)]
    for i in range(60):
        own, cut = words(rng, rng.randrange(80), 300), 0
        item = split(items[rng.randrange(len(items))][1])
        a = rng.randrange(len(item) + 1)
        piece = item[a:a + rng.randrange(5, 30)]
        texts.append((100 + i, " ".join([*own[:cut], *piece, *own[cut:]]).upper() if i % 2 else "; ".join([*own, *piece])))
    return texts, items


def test_against_brute_force(spark, case):
    texts, items = case
    assert found(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")) == brute(texts, items)


def test_many_chunks_find_the_same(spark, case):
    texts, items = case
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert found(frame(spark, texts), bench, chunk_words=120) == brute(texts, items)


def test_empty_tables(spark, empty, awkward):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(empty, none).collect() == []
    out = decontaminate(awkward, none)
    assert out.filter(F.size("hits") > 0).count() == 0 and out.count() == len(awkward_texts())
    assert out.schema["row"].dataType.names == awkward.columns


def test_equal_spans_share_a_fingerprint():
    rng = np.random.default_rng(5)
    for _ in range(200):
        span = rng.integers(0, 6, 10).astype(np.uint64)
        a, b = (np.concatenate([rng.integers(0, 6, rng.integers(0, 9)), span, rng.integers(0, 6, rng.integers(0, 9))]).astype(np.uint64)
                for _ in range(2))
        assert set(winnowed(a, 10, 5)[1]) & set(winnowed(b, 10, 5)[1])


def test_copies_of_an_item_reach_the_driver_once(spark, monkeypatch):
    made, build = [], decontamination.index_of
    monkeypatch.setattr(decontamination, "index_of", lambda ids, *a: made.append(len(ids)) or build(ids, *a))
    rng = random.Random(8)
    items = [(i, " ".join(words(rng, 15, 30))) for i in range(6)]
    texts = [(i, " ".join([*words(rng, 5, 30), item, *words(rng, 5, 30)])) for i, item in items]
    many = items + [items[0]] * 300 + [(None, None)] * 5
    bench = spark.createDataFrame(many, "item_id long, text string").repartition(4)
    assert found(frame(spark, texts), bench, chunk_words=100) == brute(texts, items)
    assert sum(made) == len(items) + 1
