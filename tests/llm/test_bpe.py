from __future__ import annotations

import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plantpulse.llm.bpe import bpe_decode, bpe_encode, bpe_round_trip, codec, vocabulary_path
from plantpulse.llm.mapping import _parts
from tests.llm.conftest import awkward_texts

OWN = codec(vocabulary_path())
LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
LIBRARY.no_truncation()
LIBRARY.no_padding()
ODD = ["A<|endoftext|>B <|startoftext|>", "<|endoftext|", "ΑΣ ΟΔΟΣ", "İstanbul ǅ ½ Ⅷ x²", "été ﬁ", "日本語😀👍🏽", "don't we'll I'M 'S '''s's",
       "a" * 5000, "!!!???..." * 300, "a\x1cb\x85c\xa0d", "</w></w>", "नमस्ते ก็", "\x00\x01", "x̀́", "aaaaaaab" * 50, "ß ẞ", "Å ﬁ é"]


def library(text: str) -> list[int]:
    return LIBRARY.encode(text, add_special_tokens=False).ids


def test_odd_texts():
    for text in ODD + [t or "" for _, t in awkward_texts()]:
        ids = OWN.encode(text)
        assert ids == library(text), text[:50]
        assert OWN.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.characters(blacklist_categories=("Cs", "Cn")), max_size=60))
def test_any_text(text):
    assert OWN.encode(text) == library(text)


def test_runs_of_few_letters():
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice("aehinrst ") for _ in range(rng.randrange(1, 60)))
        assert OWN.encode(text) == library(text)


def test_neighbouring_tokens_are_compatible():
    ids = [i for piece in ("internationalisation", "thththinger") for i in OWN.encode_piece(piece)]
    assert all(OWN.compatible(a, b) for a, b in zip(OWN.encode_piece("unbelievably"), OWN.encode_piece("unbelievably")[1:]))
    assert ids


def test_documents(awkward):
    rows = bpe_round_trip(awkward).collect()
    assert len(rows) == len(awkward_texts())
    for r in rows:
        assert r["ids"] == library(r["row"]["text"] or "")
        assert r["decoded"] == LIBRARY.decode(r["ids"], skip_special_tokens=False)
    back = bpe_decode(bpe_encode(awkward), carry=["row"])
    assert sorted(r["text"] for r in back.collect()) == sorted(r["decoded"] for r in rows)


def test_empty_table(empty):
    assert bpe_encode(empty).collect() == [] and bpe_round_trip(empty).columns == ["row", "ids", "decoded"]


def test_ddl_parts():
    assert _parts("a int, b struct<x:int,y:int>, c decimal(3,1)") == ["a int", "b struct<x:int,y:int>", "c decimal(3,1)"]
