"""Gold tables: hourly health and the daily feature store."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantpulse.functions.bands import cycles_since
from plantpulse.functions.dates import as_date, as_ntz, date_sk, hour_start
from plantpulse.functions.numeric import half_up, mean_of, ratio_or_null, stddev_from_moments
from plantpulse.operators import trailing
from plantpulse.operators.latest import latest_per_key
from plantpulse.sources.shared import materialise
from plantpulse.sources.tables import merge_latest, overwrite_table, read_table_or
from plantpulse.warehouse import Warehouse

OBSERVED_HEALTH_DEFAULT = 95


def hourly_health(telemetry: DataFrame, since: dt.datetime | str | None = None) -> DataFrame:
    """One row per asset and hour. ``latest_health_score`` is the hour's maximum."""
    rows = telemetry if since is None else telemetry.filter(F.col("recorded_at") >= as_ntz(since))
    agg = rows.groupBy(hour_start("recorded_at").alias("hour_timestamp"), "asset_id").agg(*hour_moments())
    return agg.select("hour_timestamp", "asset_id", *health_of_hour())


def hour_moments() -> list[Column]:
    """What a batch or a stream keeps of an asset's hour."""
    return [F.sum("temperature_c").alias("ts"), F.count("temperature_c").alias("tn"),
            F.max("vibration_mm_s").alias("v"), F.count("pressure_psi").alias("pn"), F.sum("pressure_psi").alias("ps"),
            F.sum(F.col("pressure_psi") * F.col("pressure_psi")).alias("pq"),
            F.max("health_score").alias("h"), F.sum("failure_probability").alias("fs"),
            F.count("failure_probability").alias("fn"), F.min("rul_days").alias("min_rul_days")]


def health_of_hour() -> list[Column]:
    """The hour's health from its moments."""
    return [half_up(mean_of(F.col("ts"), F.col("tn")), 2).alias("avg_temperature_c"),
            half_up(F.col("v"), 2).alias("max_vibration_mm_s"),
            half_up(stddev_from_moments(F.col("pn"), F.col("ps"), F.col("pq"), 2), 2).alias("stddev_pressure_psi"),
            F.col("h").cast("decimal(5,2)").alias("latest_health_score"),
            half_up(mean_of(F.col("fs"), F.col("fn")), 2).cast("decimal(3,2)").alias("avg_failure_probability"),
            F.col("min_rul_days")]


def hourly_latest_by_time(telemetry: DataFrame) -> DataFrame:
    """Health of the last reading in each hour (by time, ties by id)."""
    return latest_per_key(telemetry.withColumn("hour_timestamp", hour_start("recorded_at")),
                          ["asset_id", "hour_timestamp"], "recorded_at", ["health_score"], ["telemetry_id"])


def daily_observations(telemetry: DataFrame) -> DataFrame:
    d = F.to_date("recorded_at")
    return telemetry.select(date_sk(d).alias("observation_date_sk"), "asset_id",
                            d.alias("observation_date")).distinct()


def _daily(axis: DataFrame, features: dict[str, trailing.Feature]) -> DataFrame:
    """Features of the observed asset-days under their date key."""
    rows = trailing.with_features(axis, ["asset_id", "observation_date", "is_observed"], features)
    return trailing.observed_only(rows).select(date_sk(F.col("observation_date")).alias("observation_date_sk"), "asset_id", *features)


def feature_temp_24h(telemetry: DataFrame) -> DataFrame:
    """Mean temperature over the day before and the day itself."""
    return _daily(trailing.observation_axis(telemetry), {"avg_temp_last_24h": trailing.mean_temperature(1)})


def feature_vibration_7d(telemetry: DataFrame) -> DataFrame:
    return _daily(trailing.observation_axis(telemetry), {"vibration_stddev_7d": trailing.vibration_spread(7)})


def feature_pressure_trend(telemetry: DataFrame) -> DataFrame:
    return _daily(trailing.observation_axis(telemetry), {"pressure_trend_7d": trailing.pressure_trend(7)})


def feature_days_since(telemetry: DataFrame, service: DataFrame) -> DataFrame:
    return _daily(trailing.observation_axis(telemetry, service), {
        "days_since_last_pm": trailing.days_since("had_pm"), "days_since_last_failure": trailing.days_since("had_failure")})


def label_next_days(telemetry: DataFrame, service: DataFrame, days: int = 7) -> DataFrame:
    return _daily(trailing.observation_axis(telemetry, service), {"failed_in_next_7_days": trailing.happens_within("had_failure", days)})


def feature_rows(axis: DataFrame, prior: tuple[str | None, str | None] = (None, None)) -> DataFrame:
    """All features of an asset-day from one partitioning by asset."""
    return trailing.with_features(axis, ["asset_id", "observation_date", "is_observed", "day_health"], {
        "avg_temp_last_24h": trailing.mean_temperature(1), "vibration_stddev_7d": trailing.vibration_spread(7),
        "pressure_trend_7d": trailing.pressure_trend(7), "days_since_last_pm": trailing.days_since("had_pm", prior[0]),
        "days_since_last_failure": trailing.days_since("had_failure", prior[1]),
        "failed_in_next_7_days": trailing.happens_within("had_failure", 7)})


def maker_days(axis: DataFrame, assets: DataFrame) -> DataFrame:
    """Observed asset-days and failure days per maker and day."""
    return (axis.join(assets.select("asset_id", "oem_name"), "asset_id").groupBy("oem_name", "observation_date")
            .agg(F.count_if("is_observed").alias("obs"), F.count_if("had_failure").alias("fail")))


def oem_failure_rate(by_day: DataFrame, before_all: DataFrame | None = None) -> DataFrame:
    """Measured failure rate of a maker: failure days per observed asset-day before the day.

    Counted per (maker, day) first, so the running sum orders one row per calendar day.
    ``before_all`` has the makers' counts of the days before the first.
    """
    before = (Window.partitionBy("oem_name").orderBy("observation_date")
              .rowsBetween(Window.unboundedPreceding, -1))
    fail, obs = F.sum("fail").over(before), F.sum("obs").over(before)
    if before_all is not None:
        by_day = by_day.join(before_all.select("oem_name", "observed", "failures"), "oem_name", "left")
        fail, obs = (F.coalesce(now, F.lit(0)) + F.coalesce(F.col(c), F.lit(0)) for now, c in ((fail, "failures"), (obs, "observed")))
    return by_day.select("oem_name", "observation_date", half_up(ratio_or_null(fail, obs), 4).alias("oem_failure_rate_est"))


def _makers(wh: Warehouse) -> DataFrame:
    return wh.current_assets().select("asset_id", "oem_name", "downtime_impact_per_hour")


def feature_store(wh: Warehouse) -> DataFrame:
    """The daily feature table: observation features, maker rate, downtime risk and label.

    The asset-day moments feed both the windows and the maker rate, so they are written
    once: readings and work orders are scanned a single time.
    """
    axis = materialise(trailing.observation_axis(wh["fct_asset_telemetry"], wh.service_log()), "asset-days")
    assets = _makers(wh)
    return _store_rows(feature_rows(axis), assets, oem_failure_rate(maker_days(axis, assets)))


def _store_rows(features: DataFrame, assets: DataFrame, rates: DataFrame) -> DataFrame:
    rows = trailing.observed_only(features).join(assets, "asset_id", "left") \
        .join(rates, ["oem_name", "observation_date"], "left")
    health = F.coalesce(F.col("day_health").cast("decimal(5,2)"), F.lit(OBSERVED_HEALTH_DEFAULT).cast("decimal(5,2)"))
    risk = half_up(((F.lit(100).cast("decimal(5,2)") - health) * F.col("downtime_impact_per_hour")).cast("double"), 2)
    return rows.select(
        date_sk(F.col("observation_date")).alias("observation_date_sk"), "asset_id", "avg_temp_last_24h",
        "vibration_stddev_7d", "pressure_trend_7d",
        cycles_since(F.col("days_since_last_pm")).alias("cycles_since_last_pm"), "days_since_last_failure",
        "oem_failure_rate_est", risk.alias("downtime_impact_risk"), "failed_in_next_7_days")


@dataclass(frozen=True)
class FeatureState:
    """What all days up to a day leave for the next: last events per asset, running counts per maker."""

    assets: DataFrame  # asset_id, last_pm, last_failure
    makers: DataFrame  # oem_name, observed, failures

    def then(self, axis: DataFrame, by_day: DataFrame) -> FeatureState:
        """The state once the days of an axis have followed."""
        last = axis.groupBy("asset_id").agg(F.max(F.when(F.col("had_pm"), F.col("observation_date"))).alias("last_pm"),
                                            F.max(F.when(F.col("had_failure"), F.col("observation_date"))).alias("last_failure"))
        seen = last.filter("last_pm is not null or last_failure is not null")
        counts = by_day.select("oem_name", F.col("obs").alias("observed"), F.col("fail").alias("failures"))
        return FeatureState(
            self.assets.unionByName(seen).groupBy("asset_id").agg(*[F.max(c).alias(c) for c in ("last_pm", "last_failure")]),
            self.makers.unionByName(counts).groupBy("oem_name").agg(*[F.sum(c).alias(c) for c in ("observed", "failures")]))


def feature_state(wh: Warehouse, root: str, last: dt.date) -> FeatureState:
    """The state after day ``last`` as a load left it; without one, made once from all days up to then."""
    kept = [read_table_or(wh.spark, root, name).filter(F.col("as_of_sk") == date_sk(as_date(last))).drop("as_of_sk")
            for name in ("ml_feature_state_asset", "ml_feature_state_maker")]
    if not kept[1].isEmpty():
        return FeatureState(*kept)
    days = trailing.observation_axis(wh.between("fct_asset_telemetry", dt.date.min, last),
                                     wh.service_log().filter(F.col("completed_date") <= as_date(last)))
    return FeatureState(*(k.limit(0) for k in kept)).then(days, maker_days(days, wh.current_assets()))


def load_feature_store(wh: Warehouse, root: str, first: dt.date | str, last: dt.date | str) -> None:
    """Writes the feature rows of the days ``first`` .. ``last``, replacing those days' partitions.

    Reads the state after the day before, the readings of these days and the seven before them, and work orders up to
    seven days later (the label's); leaves the state after ``last``. Run again, it replaces the same partitions. Facts that
    arrive for an earlier day ask for loading from that day on; labels of the last seven days change with later failures.
    """
    begin, end = (dt.date.fromisoformat(str(d)) for d in (first, last))
    week = dt.timedelta(days=7)
    state = feature_state(wh, root, begin - dt.timedelta(days=1))
    service = wh.service_log().filter(F.col("completed_date").between(as_date(begin - week), as_date(end + week)))
    axis = materialise(trailing.observation_axis(wh.between("fct_asset_telemetry", begin - week, end), service), "asset-days")
    asked = F.col("observation_date").between(as_date(begin), as_date(end))
    assets, own = _makers(wh), axis.filter(asked)
    by_day = maker_days(own, assets)
    rows = feature_rows(axis.join(state.assets, "asset_id", "left"), ("last_pm", "last_failure")).filter(asked)
    then = state.then(own, by_day)
    for name, left in (("ml_feature_state_asset", then.assets), ("ml_feature_state_maker", then.makers)):
        overwrite_table(left.withColumn("as_of_sk", date_sk(as_date(end))), root, name)
    overwrite_table(_store_rows(rows, assets, oem_failure_rate(by_day, state.makers)), root, "ml_feature_store")


def load_latest_health(wh: Warehouse, root: str, first: dt.date | str, last: dt.date | str) -> None:
    """Merges the last hour of the days ``first`` .. ``last`` into the table of latest rows."""
    hours = hourly_health(wh.between("fct_asset_telemetry", first, last))
    merge_latest(hours.select("asset_id", "hour_timestamp", "latest_health_score", "avg_failure_probability", "min_rul_days"),
                 root, "agg_asset_latest_health", "hour_timestamp")


def load_hourly_health(wh: Warehouse, root: str, first: dt.date | str, last: dt.date | str) -> None:
    """Writes the Gold hours of the days ``first`` .. ``last``; only these days' readings are scanned.

    Runs again, it replaces the same partitions.
    """
    rows = hourly_health(wh.between("fct_asset_telemetry", first, last))
    overwrite_table(rows.withColumn("hour_date", F.to_date("hour_timestamp")), root, "agg_asset_hourly_health")
