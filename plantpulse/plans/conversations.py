"""Conversation analytics: counts, role alternation, context windows, exports, feedback.

Messages carry (conversation_id, turn) as key. A conversation can be any part of the
table, so ordered work goes through pieces of turns or through bounded heads and tails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantpulse.functions.dates import minutes_between
from plantpulse.functions.numeric import half_up, ratio
from plantpulse.functions.text import token_estimate, with_response_type
from plantpulse.operators.latest import first_rows
from plantpulse.operators.ordered import lead_in_pieces, number_in_pieces
from plantpulse.operators.shape import gather_chunks
from plantpulse.sources.shared import materialise

KEY = ["conversation_id"]
TURNS_PER_PIECE = 1000
MESSAGES_PER_DOCUMENT = 500

# Limits and wording of the context window.
KEEP_LAST = 15
SUMMARY_QUESTIONS = 3
NO_HISTORY = "No significant conversation history"
PREVIOUS = "Previous questions: "
MANY_BEFORE, MANY_AFTER = "User asked ", " questions about asset health, maintenance, and OEE metrics"
SUMMARY_BEFORE, SUMMARY_AFTER = "[Previous conversation summary: ", "]"


def _piece() -> Column:
    return F.floor(F.col("turn") / TURNS_PER_PIECE)


def with_turns(messages: DataFrame) -> DataFrame:
    """Adds ``turn``: the message's position by time within its conversation, from 0."""
    numbered = number_in_pieces(messages, KEY, ["timestamp", "message_id"], F.struct(F.to_date("timestamp"), F.hour("timestamp")), "__position")
    return numbered.withColumn("turn", F.col("__position").cast("bigint") - 1).drop("__position")


def conversation_analytics(messages: DataFrame) -> DataFrame:
    """Counts by role, mean non-zero response time and duration of every conversation."""
    spent = F.when((F.col("role") == "assistant") & (F.col("response_time_ms") > 0), F.col("response_time_ms"))
    sums = messages.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("total_messages"), F.count_if(F.col("role") == "user").alias("user_queries"),
        F.count_if(F.col("role") == "assistant").alias("assistant_responses"),
        F.sum(spent).alias("s"), F.count(spent).alias("n"), F.min("timestamp").alias("a"), F.max("timestamp").alias("b"))
    minutes = F.when(F.col("total_messages") < 2, F.lit(0.0)).otherwise(half_up(minutes_between(F.col("a"), F.col("b")), 2))
    return sums.select(*KEY, "total_messages", "user_queries", "assistant_responses",
                       half_up(F.coalesce(ratio(F.col("s"), F.col("n")), F.lit(0.0)), 4).alias("avg_response_time_ms"),
                       minutes.alias("duration_minutes"))


def backend_distribution(messages: DataFrame) -> DataFrame:
    rows = messages.filter(F.col("role") == "assistant")
    return rows.groupBy(*KEY, F.coalesce("backend_used", F.lit("unknown")).alias("backend")).agg(
        F.count(F.lit(1)).alias("responses"))


def alternating_roles(messages: DataFrame, has_reply: Column) -> DataFrame:
    """User and assistant messages in strict alternation, starting with the user.

    Assistant rows without stored reply content go first; of a run of one role the last
    message stays; what comes before the first user message goes.
    """
    usable = messages.filter((F.col("role") == "user") | ((F.col("role") == "assistant") & has_reply))
    start = usable.filter(F.col("role") == "user").groupBy(*KEY).agg(F.min("turn").alias("__start"))
    rows = usable.join(start, KEY).filter(F.col("turn") >= F.col("__start")).drop("__start")
    ahead = lead_in_pieces(rows, KEY, ["turn"], _piece(), "role", "__next")
    return ahead.filter(F.col("__next").isNull() | (F.col("__next") != F.col("role"))).drop("__next")


def _window_plan(messages: DataFrame, keep: int, max_messages: int, max_tokens: int) -> DataFrame:
    """Per conversation: is it cut, where head and tail are, how many questions fall between.

    The questions between are all questions less those in head and tail, so no middle
    rows are gathered to count them. One row per conversation, used three times: the
    caller writes it once.
    """
    is_user = F.col("role") == "user"
    size = messages.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("__n"), F.sum(token_estimate(F.col("content"))).alias("__tokens"),
        F.count_if(is_user).alias("__users"), F.min("turn").alias("__first"),
        F.min_by("role", "turn").alias("__first_role"))
    tails = first_rows(messages.select(*KEY, "turn", "role"), KEY, [F.col("turn").desc()], keep).groupBy(*KEY).agg(
        F.min("turn").alias("__tail"), F.count_if(is_user).alias("__tail_users"))
    cut = (F.col("__n") > max_messages) & (F.col("__tokens") >= max_tokens)
    asked = F.col("__users") - F.col("__tail_users") - F.when(F.col("__first_role") == "user", 1).otherwise(0)
    return size.join(tails, KEY).select(*KEY, "__n", "__first", "__tail", cut.alias("__cut"), asked.alias("__asked"))


def context_window(messages: DataFrame, max_messages: int = 20, max_tokens: int = 8000) -> DataFrame:
    """Messages that fit the limits: whole conversations, or first + summary + last ones.

    A conversation is cut when it has more than ``max_messages`` messages and at least
    ``max_tokens`` estimated tokens. Only bounded heads and tails of it are ordered, and
    texts are collected only where at most ``SUMMARY_QUESTIONS`` of them exist.
    """
    keep = min(KEEP_LAST, max_messages - 1)
    plan = materialise(_window_plan(messages, keep, max_messages, max_tokens), "window-plan")
    turn, inside = F.col("turn"), (F.col("turn") > F.col("__first")) & (F.col("turn") < F.col("__tail"))
    part = (F.when(~F.col("__cut"), "whole").when(turn == F.col("__first"), "first").otherwise("recent"))
    kept = messages.join(plan, KEY).filter(~(F.col("__cut") & inside)).select(
        *KEY, part.alias("part"), turn, "role", "content")

    cut = plan.filter(F.col("__cut") & (F.col("__n") > keep + 1))
    few = cut.filter(F.col("__asked").between(1, SUMMARY_QUESTIONS)).select(*KEY, "__first", "__tail")
    asked = messages.filter(F.col("role") == "user").join(few, KEY).filter(inside)
    texts = asked.groupBy(*KEY).agg(F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "content"))), lambda m: m["content"]), "; ").alias("__texts"))
    wording = (F.when(F.col("__asked") == 0, F.lit(NO_HISTORY))
               .when(F.col("__asked") <= SUMMARY_QUESTIONS, F.concat(F.lit(PREVIOUS), F.col("__texts")))
               .otherwise(F.concat(F.lit(MANY_BEFORE), F.col("__asked").cast("string"), F.lit(MANY_AFTER))))
    summaries = cut.join(texts, KEY, "left").select(
        *KEY, F.lit("summary").alias("part"), F.lit(None).cast("bigint").alias("turn"), F.lit("system").alias("role"),
        F.concat(F.lit(SUMMARY_BEFORE), wording, F.lit(SUMMARY_AFTER)).alias("content"))
    return kept.unionByName(summaries)


def response_types(messages: DataFrame) -> DataFrame:
    """Class of every assistant message."""
    replies = messages.filter(F.col("role") == "assistant").select(*KEY, "turn", "content")
    return with_response_type(replies, "content").drop("content")


def response_type_counts(texts: DataFrame, text: str, keys: list[str]) -> DataFrame:
    typed = with_response_type(texts.select(*keys, text), text)
    return typed.groupBy(*keys, "response_type").agg(F.count(F.lit(1)).alias("texts"))


def feedback_summary(feedback: DataFrame, documents: DataFrame) -> DataFrame:
    """Ratings by language and source of what was rated."""
    rated = feedback.join(documents.select(F.col("doc_id").alias("message_id"), "lang", "source"), "message_id")
    return rated.groupBy("rating", "lang", "source").agg(F.count(F.lit(1)).alias("ratings"))


def feedback_daily(feedback: DataFrame, messages: DataFrame) -> DataFrame:
    """Ratings per day of the message that was rated, and how many messages were last rated negative.

    Feedback is reduced to one row per message before the join.
    """
    per_message = feedback.groupBy("message_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("rating") == "positive").alias("p"), F.max_by("rating", "timestamp").alias("last"))
    dated = messages.select("message_id", F.to_date("timestamp").alias("day"))
    return per_message.join(dated, "message_id").groupBy("day").agg(
        F.count(F.lit(1)).alias("messages_rated"), F.sum("n").alias("ratings"), F.sum("p").alias("positive"),
        F.count_if(F.col("last") == "negative").alias("last_negative"))


def export_read_back(documents: DataFrame) -> DataFrame:
    """The messages that export documents hold, parsed from their JSON."""
    kind = "struct<messages: array<struct<message_no: bigint, role: string, content: string>>>"
    rows = documents.select(*KEY, F.explode(F.from_json("document", kind)["messages"]).alias("m"))
    return rows.select(*KEY, "m.message_no", "m.role", "m.content")


def export_rows(messages: DataFrame) -> DataFrame:
    """Messages numbered from 1 within their conversation."""
    numbered = number_in_pieces(messages, KEY, ["turn"], _piece(), "message_no")
    return numbered.select(*KEY, F.col("message_no").cast("bigint").alias("message_no"), "role", "content")


def conversation_export(messages: DataFrame) -> DataFrame:
    """Conversations as JSON documents of at most ``MESSAGES_PER_DOCUMENT`` messages each."""
    rows = export_rows(messages)
    chunk = F.floor((F.col("message_no") - 1) / MESSAGES_PER_DOCUMENT)
    item = F.struct("message_no", "role", "content")
    documents = gather_chunks(rows, KEY, chunk, item, F.col("message_no"), "messages")
    body = F.struct(F.col("conversation_id"), F.col("chunk_no"), F.size("messages").alias("message_count"), F.col("messages"))
    return documents.select(*KEY, "chunk_no", F.size("messages").alias("message_count"), F.to_json(body).alias("document"))


def last_user_message(messages: DataFrame) -> DataFrame:
    return messages.filter(F.col("role") == "user").groupBy(*KEY).agg(
        F.max_by("content", "turn").alias("content"), F.max("turn").alias("turn"))


def last_messages(messages: DataFrame, n: int) -> DataFrame:
    return first_rows(messages.select(*KEY, "turn", "role"), KEY, [F.col("turn").desc()], n, "from_end").withColumn(
        "from_end", F.col("from_end").cast("bigint"))
