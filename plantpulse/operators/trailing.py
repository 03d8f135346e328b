"""Trailing-window features, as-of dates and look-ahead labels on a daily axis.

Raw rows are reduced to one row of exact moments per (asset, day) first. What a window
then has to order is bounded by the calendar, whatever an asset's share of the readings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from plantpulse.functions.bands import NEVER_DAYS
from plantpulse.functions.dates import day_number
from plantpulse.functions.numeric import half_up, mean_of, ratio_or_null, stddev_from_moments

VIBRATION_SCALE = 4


def daily_moments(telemetry: DataFrame) -> DataFrame:
    """Counts, sums, squares and extremes per asset and day (partial aggregates before the shuffle)."""
    vib = F.col("vibration_mm_s").cast(f"decimal(8,{VIBRATION_SCALE})")
    return (telemetry.groupBy("asset_id", F.to_date("recorded_at").alias("observation_date")).agg(
        F.count("temperature_c").alias("temp_n"), F.sum("temperature_c").alias("temp_sum"),
        F.count(vib).alias("vib_n"), F.sum(vib).alias("vib_sum"),
        F.sum((vib * vib).cast(f"decimal(17,{2 * VIBRATION_SCALE})")).alias("vib_sq"),
        F.count("pressure_psi").alias("psi_n"), F.max("pressure_psi").alias("psi_max"),
        F.min("pressure_psi").alias("psi_min"), F.max("health_score").alias("day_health")))


def daily_service(service: DataFrame) -> DataFrame:
    """Whether an asset had preventive work or a failure on a day."""
    return (service.groupBy("asset_id", F.col("completed_date").alias("observation_date"))
            .agg(F.max(F.col("wo_type_id") == 3).alias("had_pm"), F.max("failure_flag").alias("had_failure")))


def _days(first: int, last: int) -> WindowSpec:
    return Window.partitionBy("asset_id").orderBy("day_no").rangeBetween(first, last)


@dataclass(frozen=True)
class Feature:
    """Named window columns and what is computed from them.

    Kept apart so that each window is computed once: formulas that round or guard repeat their input.
    """

    windows: dict[str, Column]
    value: Column


def with_features(axis: DataFrame, keep: list[str], features: dict[str, Feature]) -> DataFrame:
    """The kept columns and a column for each feature: windows first, formulas over them second."""
    windows = {name: c for f in features.values() for name, c in f.windows.items()}
    first = axis.select(*keep, *(c.alias(name) for name, c in windows.items()))
    return first.select(*keep, *(f.value.alias(name) for name, f in features.items()))


def mean_temperature(days: int) -> Feature:
    w, s, n = _days(-days, 0), f"__temp_sum_{days}", f"__temp_n_{days}"
    return Feature({s: F.sum("temp_sum").over(w), n: F.sum("temp_n").over(w)}, half_up(mean_of(F.col(s), F.col(n)), 2))


def vibration_spread(days: int) -> Feature:
    w, n, s, q = _days(-days, 0), f"__vib_n_{days}", f"__vib_sum_{days}", f"__vib_sq_{days}"
    return Feature({n: F.sum("vib_n").over(w), s: F.sum("vib_sum").over(w), q: F.sum("vib_sq").over(w)},
                   half_up(stddev_from_moments(F.col(n), F.col(s), F.col(q), VIBRATION_SCALE), 2))


def pressure_trend(days: int) -> Feature:
    """(max - min) / number of non-null pressures, NULL without any."""
    w, hi, lo, n = _days(-days, 0), f"__psi_max_{days}", f"__psi_min_{days}", f"__psi_n_{days}"
    return Feature({hi: F.max("psi_max").over(w), lo: F.min("psi_min").over(w), n: F.sum("psi_n").over(w)},
                   half_up(ratio_or_null(F.col(hi) - F.col(lo), F.col(n)), 2))


def days_since(event: str, prior: str | None = None) -> Feature:
    """Days since the last event strictly before the day, or the "never" value.

    ``prior`` names a column with the asset's last event day before the axis starts.
    """
    last = f"__last_{event}"
    seen = F.max(F.when(F.col(event), F.col("day_no"))).over(_days(Window.unboundedPreceding, -1))
    if prior:
        seen = F.greatest(seen, day_number(F.col(prior)))
    return Feature({last: F.col("day_no") - seen}, F.coalesce(F.col(last), F.lit(NEVER_DAYS)))


def happens_within(event: str, days: int) -> Feature:
    """Whether an event follows on day 1..``days``; FALSE, never NULL."""
    name = f"__next_{event}_{days}"
    return Feature({name: F.max(event).over(_days(1, days))}, F.coalesce(F.col(name), F.lit(False)))


def observation_axis(telemetry: DataFrame, service: DataFrame | None = None) -> DataFrame:
    """Daily moments with service days on the same (asset, day) axis.

    One row per asset-day that has readings, service, or both; ``is_observed`` tells
    which rows are observations. All features read windows over this one partitioning.
    """
    seen = daily_moments(telemetry).withColumn("is_observed", F.lit(True))
    if service is None:
        axis = seen
    else:
        axis = seen.unionByName(daily_service(service), allowMissingColumns=True)
    return axis.withColumn("day_no", day_number(F.col("observation_date")))


def observed_only(axis: DataFrame) -> DataFrame:
    return axis.filter(F.col("is_observed"))


def deviation_from_past(telemetry: DataFrame, days: int, k: float) -> DataFrame:
    """Readings further than ``k`` standard deviations from the mean of the ``days`` days before.

    The current day is left out. Past moments are one row per asset-day; the readings
    join them on (asset, day), which a skewed asset cannot pile into one task.
    """
    w = _days(-days, -1)
    n, s, q = (F.col(c) for c in ("past_n", "past_sum", "past_sq"))
    sums = observation_axis(telemetry).select(
        "asset_id", "observation_date", F.sum("vib_n").over(w).alias("past_n"), F.sum("vib_sum").over(w).alias("past_sum"),
        F.sum("vib_sq").over(w).alias("past_sq"))
    past = sums.select("asset_id", "observation_date", n, mean_of(s, n).alias("past_mean"),
                       stddev_from_moments(n, s, q, VIBRATION_SCALE).alias("past_std"))
    readings = (telemetry.filter(F.col("vibration_mm_s").isNotNull())
                .select("telemetry_id", "asset_id", "recorded_at", "vibration_mm_s",
                        F.to_date("recorded_at").alias("observation_date")))
    off = F.abs(F.col("vibration_mm_s").cast("double") - F.col("past_mean"))
    return (readings.join(past.filter(F.col("past_std").isNotNull()), ["asset_id", "observation_date"])
            .filter(off > F.col("past_std") * F.lit(k)))
