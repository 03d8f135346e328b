"""Dimension versions from messages that state an entity's attributes from some time on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantpulse.functions.dates import wall_micros
from plantpulse.operators.ordered import lead_in_pieces

_PIECE_MICROS = 30 * 86_400_000_000


def versions_of(messages: DataFrame, key: str, effective: str, arrived: str, attributes: Sequence[str]) -> DataFrame:
    """key, attributes, scd_start_date, scd_end_date, is_current: intervals without gap or overlap.

    Of messages for the same time the last to arrive counts (equal arrivals: the greatest attributes). A message that
    changes nothing opens no version. An entity's messages are ordered in pieces of thirty days, so one
    entity with a third of all messages is not one task. The greatest of a struct is found by sorting: messages are spread
    first, or each task sorts all it has read (a small file can hold millions), and large partitions are split.
    """
    said = F.struct(arrived, *attributes)
    dated = messages.filter(F.col(key).isNotNull() & F.col(effective).isNotNull())
    spread = dated.hint("rebalance", F.col(key), F.col(effective), F.col(arrived))
    one = spread.groupBy(key, effective).agg(F.max(said).alias("__m"))
    at = wall_micros(F.col(effective))
    rows = one.select(key, effective, *[F.col(f"__m.{c}").alias(c) for c in attributes], at.alias("__at"), (-at).alias("__back"))
    rows = rows.withColumn("__print", F.xxhash64(*attributes))
    before = lead_in_pieces(rows, [key], ["__back"], F.floor(F.col("__back") / F.lit(_PIECE_MICROS)), "__print", "__before")
    changed = before.filter(F.col("__before").isNull() | (F.col("__before") != F.col("__print")))
    closed = lead_in_pieces(changed, [key], ["__at"], F.floor(F.col("__at") / F.lit(_PIECE_MICROS)), effective, "scd_end_date")
    return closed.select(key, *attributes, F.col(effective).alias("scd_start_date"), "scd_end_date",
                         F.col("scd_end_date").isNull().alias("is_current"))


def merge_versions(versions: DataFrame, messages: DataFrame, arrived_now: DataFrame, key: str, effective: str, arrived: str,
                   attributes: Sequence[str]) -> DataFrame:
    """Versions after new messages, some of them for times that are already past.

    Only entities that new messages speak of are made again, from all their messages (a correction can split a
    version, join two or bring back one that changed nothing before); all others stay. A load can speak of nearly all
    entities, so they are never broadcast.
    """
    touched = arrived_now.select(key).distinct().hint("merge")
    again = versions_of(messages.join(touched, key, "left_semi"), key, effective, arrived, attributes)
    return versions.join(touched, key, "left_anti").unionByName(again)


def broken_intervals(versions: DataFrame, key: str) -> DataFrame:
    """Entities whose versions don't end where another begins, or of which not exactly one is open."""
    ends = versions.groupBy(key, F.col("scd_end_date").alias("at")).agg(F.count("*").alias("ends"))
    starts = versions.groupBy(key, F.col("scd_start_date").alias("at")).agg(F.count("*").alias("starts"))
    first = versions.groupBy(key).agg(F.min("scd_start_date").alias("first"))
    both = ends.join(starts, [key, "at"], "full_outer").join(first, key)
    fine = F.when(F.col("at").isNull(), F.col("ends") == 1).when(F.col("at") == F.col("first"), F.col("starts") == 1) \
        .otherwise((F.col("starts") == 1) & (F.col("ends") == 1))
    return both.filter(~F.coalesce(fine, F.lit(False))).select(key).distinct()
