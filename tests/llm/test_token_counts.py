from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from plantpulse.llm.queries import op10_token_counts
from plantpulse.llm.token_counts import VOCABULARY, _broken, allocate, counter, token_counts
from tests.llm.conftest import awkward_texts

OWN = counter(public_tokenizers.path(VOCABULARY))


def brute(first, last, start, end, rule):
    counts, outside, crossing = [0.0] * len(start), 0.0, 0
    for a, b in zip(first, last):
        owner = [next((i for i, (s, e) in enumerate(zip(start, end)) if s <= c < e), None) for c in range(a, b + 1)]
        crossing += len({*owner}) > 1
        if rule == "split":
            shares = {o: owner.count(o) / len(owner) for o in owner}
        elif rule == "most":
            shares = {max(dict.fromkeys(owner), key=owner.count): 1}
        else:
            shares = {owner[0 if rule == "first" else -1]: 1}
        for o, x in shares.items():
            if o is None:
                outside += x
            else:
                counts[o] += x
    return counts, outside, crossing


@pytest.mark.parametrize("rule", ["first", "last", "most", "split"])
def test_rules_against_brute_force(rule):
    rng = random.Random(rule)
    for _ in range(300):
        cuts = sorted(rng.sample(range(40), rng.randrange(2, 12)))
        first, last = np.array(cuts[:-1]), np.array(cuts[1:]) - 1
        edges = sorted(rng.sample(range(45), 2 * rng.randrange(0, 6)))
        if rng.random() < 0.5 and len(edges) > 3:
            edges[2] = edges[1]  # sections that touch
        start, end = np.array(edges[::2], int), np.array(edges[1::2], int)
        keep = end > start
        start, end = start[keep], end[keep]
        got, want = allocate(first, last, start, end, rule), brute(first, last, start, end, rule)
        assert np.allclose(got[0], want[0]) and abs(got[1] - want[1]) < 1e-9 and got[2] == want[2]


def test_spans_cover_the_text():
    for _, text in awkward_texts():
        if text:
            first, last = OWN.spans(text)
            assert first[0] == 0 and last[-1] == len(text) - 1 and (np.diff(first) >= 0).all() and (first <= last).all()


def test_documents(awkward):
    rows = token_counts(awkward).collect()
    assert len(rows) == len(awkward_texts())
    for r in rows:
        text = r["row"]["text"] or ""
        assert r.n_tokens == len(OWN.encoding.encode_ordinary(text))
        assert sum(r.by_section) + r.outside == r.n_tokens


def test_given_sections(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma", [(6, 11), (0, 6), (None, 3), (90, 99)]), (2, None, [(0, 1)]), (3, "x", None)],
                                 "doc_id long, text string, parts array<struct<start:bigint,end:bigint>>")
    got = {r["row"]["doc_id"]: (r.n_tokens, list(r.by_section), r.outside) for r in token_counts(docs, "parts", "first").collect()}
    first, _ = OWN.spans("alpha beta gamma")
    assert got[1] == (len(first), [float(((first >= 6) & (first < 11)).sum()), float((first < 6).sum()), 0.0, 0.0], float((first >= 11).sum()))
    assert got[2] == (0, [0.0], 0.0) and got[3] == (1, [], 1.0)


def test_overlapping_sections(spark):
    """The section that starts first has the characters; what is left of the later one may be nothing."""
    text = "alpha beta gamma delta"
    parts = [(6, 16), (0, 8), (2, 5), (10, 22), (6, 16)]
    docs = spark.createDataFrame([(1, text, parts)], "doc_id long, text string, parts array<struct<start:bigint,end:bigint>>")
    (row,) = token_counts(docs, "parts", "first").collect()
    first, _ = OWN.spans(text)
    owner = [8, 0, None, 16, None]
    ends = [16, 8, None, 22, None]
    want = [0.0 if a is None else float(((first >= a) & (first < b)).sum()) for a, b in zip(owner, ends)]
    assert list(row.by_section) == want and row.outside == 0


def test_query_against_the_library(spark):
    """Every number of the query from the library's own offsets: sentences, the rule ``most``, what crosses."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    for r in op10_token_counts(spark, "/root/testdata/sf0.001").collect():
        text = docs[r.doc_id]
        start, end = _broken(text) if text else (np.empty(0, int), np.empty(0, int))
        first, last = OWN.spans(text) if text else (np.empty(0, int), np.empty(0, int))
        counts, _, crossing = brute(first, last, start, end, "most")
        digest = hashlib.sha256(" ".join(str(int(c)) for c in counts).encode()).hexdigest()
        assert (r.n_tokens, r.n_sections, r.crossing) == (len(first), len(start), crossing)
        assert r.most_tokens == (max(counts) if len(counts) else 0) and r.sections_sha256 == digest


def test_empty_table(empty):
    assert token_counts(empty).select(F.size("by_section")).collect() == []
    with pytest.raises(ValueError):
        token_counts(empty, rule="none")
