"""Shares of a total and change against an earlier period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantpulse.functions.numeric import half_up, ratio


def with_share(totals: DataFrame, measure: str, share: str, digits: int = 6,
               within: Sequence[str] = ()) -> DataFrame:
    """Each row's part of the sum over ``within`` (over everything when empty).

    Takes already aggregated rows: the window sees one row per group.
    """
    w = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    total = F.sum(measure).over(w)
    return totals.withColumn(share, half_up(ratio(F.col(measure), total), digits))


def with_previous(totals: DataFrame, measure: str, period: str, into: str, before: Column,
                  within: Sequence[str] = ()) -> DataFrame:
    """The measure of the period before (aggregated rows only), NULL where that period has no row.

    ``before`` gives the adjacent earlier period of a row: a gap is not bridged.
    """
    w = Window.partitionBy(*(within or [F.lit(0)])).orderBy(period)
    return totals.withColumn(into, F.when(F.lag(period).over(w) == before, F.lag(measure).over(w)))


def growth(current: Column, previous: Column, digits: int = 6) -> Column:
    """(current - previous) / previous, NULL without a non-zero previous value."""
    c, p = current.cast("double"), previous.cast("double")
    return F.when(p != 0, half_up((c - p) / p, digits))


def against_prior_mean(daily: DataFrame, day: str, measure: str, rows: int = 7) -> DataFrame:
    """Latest value next to the mean of the ``rows`` observations before it, as one row.

    With fewer than ``rows`` + 1 observations the mean falls back to the latest value.
    ``daily`` holds one row per day of a bounded range.
    """
    w = Window.partitionBy(F.lit(0)).orderBy(F.col(day).desc())
    ranked = daily.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= rows + 1)
    picked = ranked.agg(
        F.max(F.when(F.col("__n") == 1, F.col(measure))).alias("current"),
        F.array_sort(F.collect_list(F.when(F.col("__n") > 1, F.struct(F.col("__n").alias("n"), F.col(measure).alias("v")))))
        .alias("__before"),
        F.count(F.lit(1)).alias("__have"))
    total = F.aggregate("__before", F.lit(0.0), lambda acc, x: acc + x["v"])
    prior = F.when(F.col("__have") >= rows + 1, total / F.lit(float(rows))).otherwise(F.col("current"))
    return picked.select("current", prior.alias("prior_mean"), F.col("__have").alias("observations"))
