"""Conversation analytics on hand-made messages."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plantpulse.plans import conversations as conv

SCHEMA = "conversation_id string, turn bigint, role string, content string, timestamp timestamp_ntz, backend_used string, response_time_ms bigint"


def messages(spark, rows):
    data = [(c, i, role, text, dt.datetime(2025, 1, 1) + dt.timedelta(seconds=30 * i), backend, ms) for c, i, role, text, backend, ms in rows]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture
def talk(spark):
    return messages(spark, [
        ("a", 0, "user", "hi", None, None), ("a", 1, "assistant", "x", "agent", 100), ("b", 0, "user", "only", None, None)])


def test_analytics(spark, talk):
    rows = messages(spark, [("z", 0, "user", "q", None, None), ("z", 1, "assistant", "r", "agent", 0)])
    got = {r.conversation_id: tuple(r)[1:] for r in conv.conversation_analytics(talk.union(rows)).collect()}
    assert got == {"a": (2, 1, 1, 100.0, 0.5), "b": (1, 1, 0, 0.0, 0.0), "z": (2, 1, 1, 0.0, 0.5)}


def test_backend_unknown(spark):
    rows = messages(spark, [("a", 0, "assistant", "x", None, 1), ("a", 1, "assistant", "x", "agent", 1)])
    assert {(r.backend, r.responses) for r in conv.backend_distribution(rows).collect()} == {("unknown", 1), ("agent", 1)}


@pytest.mark.parametrize("size", [1, 2, 1000])
def test_alternation(spark, monkeypatch, size):
    monkeypatch.setattr(conv, "TURNS_PER_PIECE", size)
    roles = ["assistant", "user", "user", "assistant", "assistant", "user", "system", "user", "assistant"]
    rows = messages(spark, [("a", i, r, f"m{i}", None, None) for i, r in enumerate(roles)] + [("b", 0, "assistant", "alone", None, None)])
    kept = conv.alternating_roles(rows, F.col("turn") != 8).orderBy("turn").collect()
    assert [(r.conversation_id, r.turn) for r in kept] == [("a", 2), ("a", 4), ("a", 7)]


def long_talk(spark, n, chars):
    return messages(spark, [("a", i, "user" if i % 2 else "assistant", f"m{i}".ljust(chars, "."), None, None) for i in range(n)])


@pytest.mark.parametrize("n, chars, cut", [(20, 4000, False), (21, 100, False), (21, 1600, True)])
def test_context_window_triggers(spark, n, chars, cut):
    got = conv.context_window(long_talk(spark, n, chars)).collect()
    assert len(got) == (17 if cut else n)
    assert {r.part for r in got} == ({"first", "summary", "recent"} if cut else {"whole"})
    if cut:
        assert sorted(r.turn for r in got if r.part == "recent") == list(range(6, 21))
        asked = [f"m{i}".ljust(chars, ".") for i in (1, 3, 5)]
        assert [r.content for r in got if r.part == "summary"] == [
            "[Previous conversation summary: Previous questions: " + "; ".join(asked) + "]"]


def test_context_window_many_and_no_questions(spark):
    many = conv.context_window(long_talk(spark, 24, 1600)).filter("part = 'summary'").first()
    assert many.content == "[Previous conversation summary: User asked 4 questions about asset health, maintenance, and OEE metrics]"
    silent = messages(spark, [("a", i, "assistant", "x" * 400, None, None) for i in range(6)])
    row = conv.context_window(silent, max_messages=4, max_tokens=100).filter("part = 'summary'").first()
    assert row.content == "[Previous conversation summary: No significant conversation history]"


def test_export_is_whole_and_bounded(spark, monkeypatch):
    monkeypatch.setattr(conv, "MESSAGES_PER_DOCUMENT", 10)
    monkeypatch.setattr(conv, "TURNS_PER_PIECE", 7)
    docs = conv.conversation_export(long_talk(spark, 25, 5)).orderBy("chunk_no").collect()
    assert [r.message_count for r in docs] == [10, 10, 5]
    assert docs[2].document.startswith('{"conversation_id":"a","chunk_no":2,"message_count":5,"messages":[{"message_no":21,')


def test_last_user_message(spark, talk):
    assert {r.conversation_id: r.content for r in conv.last_user_message(talk).collect()} == {"a": "hi", "b": "only"}
