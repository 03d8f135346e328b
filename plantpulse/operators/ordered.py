"""Ordered analytics that stay spread out when one group holds a large part of the rows.

A window over a group sorts the whole group in one task. Each operator here first works
inside small pieces of a group, reduces a piece to one row, and only orders those rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantpulse.functions.dates import wall_micros


def lead_in_pieces(df: DataFrame, keys: Sequence[str], order: Sequence[str], piece: Column,
                   value: str, into: str) -> DataFrame:
    """``lead(value)`` over (keys, order), without gathering a key in one task.

    ``piece`` must not decrease along ``order``. Inside a piece the lead is a plain
    window; the last row of a piece takes the first value of the next piece, found over
    one row per piece. These meet in a sort-merge join: there can be as many pieces as rows,
    and before a run Spark takes them for smaller than they are and would broadcast them.
    """
    pieces = df.withColumn("__piece", piece)
    inner = Window.partitionBy(*keys, "__piece").orderBy(*order)
    rows = (pieces.withColumn("__lead", F.lead(F.struct(value)).over(inner)))
    heads = pieces.groupBy(*keys, "__piece").agg(F.min_by(F.struct(value), F.struct(*order)).alias("__head"))
    between = Window.partitionBy(*keys).orderBy("__piece")
    nexts = heads.select(*keys, "__piece", F.lead("__head").over(between).alias("__next"))
    joined = rows.join(nexts.hint("merge"), [*keys, "__piece"], "left")
    return (joined.withColumn(into, F.coalesce(F.col("__lead"), F.col("__next"))[value])
            .drop("__piece", "__lead", "__next"))


def number_in_pieces(df: DataFrame, keys: Sequence[str], order: Sequence[str], piece: Column,
                     into: str) -> DataFrame:
    """``row_number()`` over (keys, order), without gathering a key in one task."""
    pieces = df.withColumn("__piece", piece)
    inner = Window.partitionBy(*keys, "__piece").orderBy(*order)
    rows = pieces.withColumn("__no", F.row_number().over(inner))
    before = Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (pieces.groupBy(*keys, "__piece").agg(F.count(F.lit(1)).alias("__size"))
               .select(*keys, "__piece", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset")))
    return (rows.join(offsets, [*keys, "__piece"])
            .withColumn(into, F.col("__no") + F.col("__offset")).drop("__piece", "__no", "__offset"))


def sessions(df: DataFrame, keys: Sequence[str], ts: str, gap_minutes: int) -> DataFrame:
    """Runs of rows at most ``gap_minutes`` apart: start, last row, number of rows.

    Two rows in the same gap-long slot always share a session, so a hash aggregate per
    slot (with map-side combine) loses nothing; the window then orders one row per slot.
    """
    return sessions_of_slots(session_slots(df, keys, ts, gap_minutes), keys, gap_minutes)


def session_slots(df: DataFrame, keys: Sequence[str], ts: str, gap_minutes: int) -> DataFrame:
    """One row for each gap-long slot of a key that holds rows."""
    gap = gap_minutes * 60_000_000
    return (df.groupBy(*keys, F.floor(wall_micros(F.col(ts)) / F.lit(gap)).alias("__slot"))
            .agg(F.min(ts).alias("__first"), F.max(ts).alias("__last"), F.count(F.lit(1)).alias("__n")))


def sessions_of_slots(slots: DataFrame, keys: Sequence[str], gap_minutes: int, at_gap: bool = True) -> DataFrame:
    """Sessions from slots; ``at_gap`` says whether rows exactly a gap apart still belong together."""
    gap = gap_minutes * 60_000_000
    w = Window.partitionBy(*keys).orderBy("__slot")
    apart = wall_micros(F.col("__first")) - wall_micros(F.lag("__last").over(w))
    marked = slots.withColumn("__new", F.when(apart <= gap if at_gap else apart < gap, 0).otherwise(1))
    numbered = marked.withColumn("__session", F.sum("__new").over(w))
    return (numbered.groupBy(*keys, "__session")
            .agg(F.min("__first").alias("session_start"), F.max("__last").alias("last_reading"),
                 F.sum("__n").alias("readings")).drop("__session"))
