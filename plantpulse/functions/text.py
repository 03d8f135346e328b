"""Text helpers: response classes, path levels, display strings, token estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The keyword classes, tried in this order.
ERROR_WORDS = ("error", "failed", "unable to")
ACTION_WORDS = ("created", "scheduled", "completed", "work order")
DATA_WORDS = ("query results",)
DATA_MARK = "\U0001F4CA"


def _has_any(text: Column, words: tuple[str, ...]) -> Column:
    hit = text.contains(words[0])
    for word in words[1:]:
        hit = hit | text.contains(word)
    return hit


def response_class(low: Column, text: Column) -> Column:
    """Class of a text given beside its lower-case form."""
    return (F.when(_has_any(low, ERROR_WORDS), "error")
            .when(_has_any(low, ACTION_WORDS), "action")
            .when(_has_any(low, DATA_WORDS) | text.contains(DATA_MARK), "data")
            .otherwise("assistant"))


def with_response_type(df: DataFrame, text: str, into: str = "response_type") -> DataFrame:
    """Adds the response class of a text column.

    Lower-casing is a projection of its own: inside the branches it would be repeated
    for every keyword.
    """
    low = df.withColumn("__low", F.lower(F.col(text)))
    return low.withColumn(into, response_class(F.col("__low"), F.col(text))).drop("__low")


def path_level(path: Column, level: int) -> Column:
    """Segment ``level`` (0-based) of a slash path, NULL when the path is shorter."""
    return F.try_element_at(F.split(path, "/"), F.lit(level + 1))


def path_depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def under_path(path: Column, prefix: str) -> Column:
    """True for the node itself and everything below it."""
    return (path == prefix) | path.startswith(prefix + "/")


def token_estimate(text: Column) -> Column:
    """Rough token count: one per four characters."""
    return F.length(F.coalesce(text, F.lit(""))).cast("double") / F.lit(4.0)


def percent_text(value01: Column) -> Column:
    return F.format_string("%.1f%%", value01.cast("double") * 100)


def hourly_cost_text(value: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(value.cast("double"), 0), F.lit("/hr"))


def note_preview(note: Column, length: int = 100) -> Column:
    return F.substring(note, 1, length)
