"""Every stage on the awkward documents against brute force on the same input."""

from __future__ import annotations

import random
from collections import Counter

import pytest

import corpus_pipeline
from plantpulse.llm.bpe import codec, vocabulary_path
from tests.llm import test_decontamination, test_jaccard_join, test_substring_dedup
from tests.llm.conftest import awkward_texts, frame, words

STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    path = str(tmp_path_factory.mktemp("tables"))
    item = " ".join(words(rng, 30, 9000))
    texts = awkward_texts() + [(30, f"leak: {item}"), (31, f"{item} with more words around it"), (32, "clean words only")]
    texts += [(1000 + i, ("good " if i % 2 else "$$$ ### ") * 30 + " ".join(words(rng, 30, 9000))) for i in range(160)]
    frame(spark, texts).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(1000 + i, i % 2, 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, texts


def run(spark, folder, name, docs=None):
    docs = spark.read.parquet(f"{folder}/documents.parquet") if docs is None else docs
    out = STAGE[name](spark, docs, folder)
    if name != "bpe":
        assert out.columns == docs.columns
    return out.collect()


def test_stages_in_order():
    assert list(STAGE) == ["quality_classifier", "jaccard_join", "substring_dedup", "decontamination", "bpe"]


def test_quality(spark, folder):
    kept = {r.doc_id for r in run(spark, folder[0], "quality_classifier")}
    good, bad = ({1000 + i for i in range(k, 160, 2)} for k in (1, 0))
    assert good <= kept and len(kept & bad) <= 4  # fitted on 120 short documents


def test_near_copies(spark, folder):
    got = Counter(r.doc_id for r in run(spark, folder[0], "jaccard_join"))
    groups = test_jaccard_join.brute(folder[1])
    bare = Counter(d for d, n, _ in groups if not n)  # without words: all stay
    assert got == bare + Counter({g for _, n, g in groups if n and g is not None}) + Counter(d for d, n, g in groups if n and g is None)


def test_repeated_passages(spark, folder):
    texts = folder[1]
    got = Counter((r.doc_id, r.text, r.n_chars) for r in run(spark, folder[0], "substring_dedup"))
    want = Counter()
    for (doc, text), (_, gone, kept) in zip(texts, test_substring_dedup.brute([t for _, t in texts], 35)):
        new = kept if gone else text
        want[doc, new, None if new is None else len(new)] += 1
    assert got == want


def test_leaks(spark, folder):
    item = spark.read.parquet(f"{folder[0]}/benchmark.parquet").first()
    hits = test_decontamination.brute(folder[1], [(item.item_id, item.text)])
    want = Counter()
    for (doc, _, hit, _), n in hits.items():
        want[doc] += n if not hit else 0
    assert Counter(r.doc_id for r in run(spark, folder[0], "decontamination")) == +want
    assert want[30] == 0 and want[31] == 0 and want[32] == 1


def test_tokens(spark, folder):
    own = codec(vocabulary_path())
    got = Counter((r.doc_id, tuple(r.ids)) for r in run(spark, folder[0], "bpe"))
    assert got == Counter((doc, tuple(own.encode(text))) for doc, text in folder[1])


def test_whole_run_and_empty_tables(spark, folder, empty, tmp_path):
    out = corpus_pipeline.run(spark, folder[0]).collect()
    assert out and len({r.doc_id for r in out}) >= 15
    for table, source in (("documents", empty), ("labels", spark.read.parquet(f"{folder[0]}/labels.parquet").limit(0)),
                          ("benchmark", spark.read.parquet(f"{folder[0]}/benchmark.parquet").limit(0))):
        source.write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
