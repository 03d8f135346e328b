"""The named queries against their SQL, and those without against checks of whole results."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from plantpulse.llm import queries as llm
from tests.compare import difference, oracle

SF = "/root/testdata/sf0.001"
QUERIES, SQLS = llm.queries(), llm.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


def test_one_query_for_each_operator():
    assert {q.split("_")[0] for q in QUERIES} == {"pipeline", *(f"op{n}" for n in range(1, 14))}
    assert set(SQLS) == {q for q in QUERIES if q.split("_")[0] in {"op1", "op3", "op4", "op5", "op7", "op8", "op11", "op12"}}
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", sorted(SQLS))
def test_matches_sql(spark, con, name):
    assert difference(spark, con, QUERIES[name], SQLS[name], SF) is None


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_bpe_matches_the_library(spark, con):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    rows = {r.doc_id: r for r in QUERIES["op2_bpe"](spark, SF).collect()}
    for doc, text in con.execute("SELECT doc_id, text FROM documents").fetchall():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        r = rows.pop(doc)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), digest(" ".join(map(str, ids))))
        assert r.decoded_sha256 == digest(tokenizer.decode(ids, skip_special_tokens=False))
    assert not rows


def test_classifier_and_counts_return_every_document(spark, con):
    n = con.execute("SELECT count(*) FROM documents").fetchone()[0]
    assert QUERIES["op6_quality_classifier"](spark, SF).count() == n
    assert QUERIES["op10_token_counts"](spark, SF).count() == n
