"""Analyst questions on telemetry, health and the feature store."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plantpulse.functions.dates import date_sk, month_start
from plantpulse.functions.numeric import half_up, ratio_or_null, stddev_from_moments
from plantpulse.operators.joins import FactPart, drill_across, place_assets, star_join
from plantpulse.operators.latest import head_with_rest, order_key, top_rows
from plantpulse.operators.trailing import VIBRATION_SCALE, deviation_from_past
from plantpulse.plans.health import GOLD, latest_health
from plantpulse.warehouse import Warehouse

Day = dt.date | str
Now = dt.datetime | str
TELEMETRY = "fct_asset_telemetry"


def _mean(total: str, count: str, digits: int = 4):
    return half_up(ratio_or_null(F.col(total), F.col(count)), digits)


def health_by_oem(wh: Warehouse, as_of: Now, days: int = 30) -> DataFrame:
    """Mean health by maker over the last days, ranked. Summed per asset before the join."""
    per_asset = wh.last_hours(GOLD, as_of, days * 24).groupBy("asset_id").agg(
        F.sum("latest_health_score").alias("s"), F.count("latest_health_score").alias("n"))
    makers = wh.current_assets().select("asset_id", "oem_name")
    sums = per_asset.join(makers, "asset_id").groupBy("oem_name").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("avg_health").desc(), F.col("oem_name"))
    return sums.select("oem_name", _mean("s", "n").alias("avg_health")).withColumn(
        "rank_no", F.row_number().over(w).cast("bigint"))


def weak_assets(wh: Warehouse) -> DataFrame:
    """Assets whose latest health is below and probability above the fleet's average."""
    latest = latest_health(wh).select("asset_id", F.col("latest_health_score").cast("double").alias("health"),
                                      F.col("avg_failure_probability").cast("double").alias("probability"))
    fleet = latest.agg(F.struct(F.avg("health").alias("h"), F.avg("probability").alias("p"))).scalar()
    return latest.filter((F.col("health") < fleet["h"]) & (F.col("probability") > fleet["p"]))


def _health_by_place(wh: Warehouse, place: list[str], day: bool, rows: DataFrame) -> DataFrame:
    keys = [F.to_date("hour_timestamp").alias("health_date")] if day else []
    per_asset = rows.groupBy("asset_id", *keys).agg(
        F.sum("latest_health_score").alias("s"), F.count("latest_health_score").alias("n"))
    placed = per_asset.join(place_assets(wh.current_assets(), wh, place), "asset_id")
    out = [*place, "health_date"] if day else place
    return placed.groupBy(*out).agg(F.sum("s").alias("s"), F.sum("n").alias("n")).select(*out, _mean("s", "n").alias("avg_health"))


def health_trend_plant(wh: Warehouse, as_of: Now, plant_name: str, days: int = 30) -> DataFrame:
    rows = _health_by_place(wh, ["plant_name"], True, wh.last_hours(GOLD, as_of, days * 24))
    return rows.filter(F.col("plant_name") == plant_name)


def health_by_plant(wh: Warehouse) -> DataFrame:
    return _health_by_place(wh, ["plant_name"], False, wh[GOLD])


def health_by_line(wh: Warehouse) -> DataFrame:
    return _health_by_place(wh, ["line_name"], False, wh[GOLD])


def flagged_assets(wh: Warehouse) -> DataFrame:
    """Assets whose last reading is anomalous (aggregate: one row per asset leaves each task)."""
    last = wh[TELEMETRY].groupBy("asset_id").agg(
        F.max_by("is_anomalous", order_key(F.col("recorded_at"), F.col("telemetry_id"))).alias("flag"), F.max("recorded_at").alias("recorded_at"))
    return last.filter("flag").select("asset_id", "recorded_at")


def lowest_life(wh: Warehouse) -> DataFrame:
    return top_rows(latest_health(wh).select("asset_id", "min_rul_days"), [F.col("min_rul_days"), F.col("asset_id")], 1)


def metric_summary(wh: Warehouse, as_of: Now) -> DataFrame:
    """Mean temperature of 24 hours, highest vibration and mean pressure of 7 days, in one scan of 7 days."""
    rows = wh.last_hours(TELEMETRY, as_of, 168)
    day_start = F.lit(str(as_of)).cast("timestamp_ntz") - F.expr("INTERVAL 24 HOURS")
    recent = F.when(F.col("recorded_at") >= day_start, F.col("temperature_c"))
    sums = rows.agg(F.sum(recent).alias("ts"), F.count(recent).alias("tn"), F.max("vibration_mm_s").alias("v"),
                    F.sum("pressure_psi").alias("ps"), F.count("pressure_psi").alias("pn"))
    return sums.select(_mean("ts", "tn").alias("avg_temperature_24h"), F.col("v").cast("double").alias("max_vibration_7d"),
                       _mean("ps", "pn").alias("avg_pressure_7d"))


def age_health_correlation(wh: Warehouse, as_of: Day) -> DataFrame:
    age = F.datediff(F.lit(str(as_of)).cast("date"), F.col("installation_date"))
    rows = latest_health(wh).join(wh.current_assets().select("asset_id", "installation_date"), "asset_id")
    return rows.agg(F.count(F.lit(1)).alias("assets"), half_up(
        F.corr(age.cast("double"), F.col("latest_health_score").cast("double")), 4).alias("correlation"))


def vibration_trend(wh: Warehouse, as_of: Now, asset_id: int, days: int = 30) -> DataFrame:
    """Daily mean vibration of one asset."""
    rows = wh.last_hours(TELEMETRY, as_of, days * 24).filter(F.col("asset_id") == asset_id)
    daily = rows.groupBy(F.to_date("recorded_at").alias("reading_date")).agg(
        F.sum("vibration_mm_s").alias("s"), F.count("vibration_mm_s").alias("n"))
    return daily.select("reading_date", _mean("s", "n").alias("avg_vibration"))


def vibration_spread_of_class(wh: Warehouse, class_name: str) -> DataFrame:
    """Spread of vibration per asset of a class, from moments summed before the join."""
    v = F.col("vibration_mm_s").cast(f"decimal(8,{VIBRATION_SCALE})")
    sums = wh[TELEMETRY].groupBy("asset_id").agg(
        F.count(v).alias("n"), F.sum(v).alias("s"), F.sum((v * v).cast("decimal(17,8)")).alias("q"))
    chosen = wh.current_assets().join(
        wh["dim_asset_class"].filter(F.col("class_name") == class_name), "asset_class_id").select("asset_id")
    return sums.join(chosen, "asset_id", "left_semi").select("asset_id", half_up(
        stddev_from_moments(F.col("n"), F.col("s"), F.col("q"), VIBRATION_SCALE), 4).alias("vibration_stddev"))


def risk_trend_slope(wh: Warehouse, as_of: Now, days: int = 30) -> DataFrame:
    """Assets whose daily failure probability rises over the period (least-squares slope per day)."""
    daily = wh.last_hours(GOLD, as_of, days * 24).groupBy("asset_id", F.to_date("hour_timestamp").alias("d")).agg(
        F.sum("avg_failure_probability").alias("s"), F.count("avg_failure_probability").alias("n"))
    points = daily.select("asset_id", F.unix_date("d").cast("double").alias("x"), ratio_or_null(F.col("s"), F.col("n")).alias("y"))
    slopes = points.groupBy("asset_id").agg(F.count(F.lit(1)).alias("points"), half_up(F.regr_slope("y", "x"), 5).alias("slope"))
    return slopes.filter(F.col("slope") > 0)


def probability_change(wh: Warehouse, first: tuple[Day, Day], second: tuple[Day, Day]) -> DataFrame:
    """Mean failure probability of two periods and the change, in one scan over both."""
    (a, b), (c, d) = first, second
    day = F.to_date("hour_timestamp")
    lit = lambda v: F.lit(str(v)).cast("date")
    in_first, in_second = day.between(lit(a), lit(b)), day.between(lit(c), lit(d))
    p = F.col("avg_failure_probability")
    sums = wh.between(GOLD, min(str(a), str(c)), max(str(b), str(d))).agg(
        F.sum(F.when(in_first, p)).alias("s1"), F.count(F.when(in_first, p)).alias("n1"),
        F.sum(F.when(in_second, p)).alias("s2"), F.count(F.when(in_second, p)).alias("n2"))
    one, two = ratio_or_null(F.col("s1"), F.col("n1")), ratio_or_null(F.col("s2"), F.col("n2"))
    return sums.select(half_up(one, 6).alias("first_mean"), half_up(two, 6).alias("second_mean"),
                       half_up(two - one, 6).alias("change"))


def predicted_failures(wh: Warehouse, on_day: Day) -> DataFrame:
    """Assets whose last observation up to a day carries the failure label."""
    labels = wh["ml_feature_store"].select("asset_id", "observation_date_sk", "failed_in_next_7_days").filter(
        F.col("observation_date_sk") <= date_sk(F.lit(str(on_day)).cast("date")))
    last = labels.groupBy("asset_id").agg(F.max("observation_date_sk").alias("observation_date_sk"),
                                          F.max_by("failed_in_next_7_days", "observation_date_sk").alias("flag"))
    return last.filter("flag").select("asset_id", "observation_date_sk")


def impact_below_health(wh: Warehouse, below: float = 80) -> DataFrame:
    rows = latest_health(wh).filter(F.col("latest_health_score") < below).join(
        wh.current_assets().select("asset_id", "downtime_impact_per_hour"), "asset_id")
    return rows.agg(F.count(F.lit(1)).alias("assets"), F.sum("downtime_impact_per_hour").cast("double").alias("impact_per_hour"))


def cycles_of_failed(wh: Warehouse) -> DataFrame:
    """Mean cycles since preventive work over observation days whose asset failed in the next 7 days."""
    rows = wh["ml_feature_store"].filter("failed_in_next_7_days")
    return rows.agg(F.count(F.lit(1)).alias("observations"), half_up(
        ratio_or_null(F.sum("cycles_since_last_pm"), F.count(F.lit(1))), 4).alias("mean_cycles"))


def impact_risk_by_plant(wh: Warehouse) -> DataFrame:
    """Downtime impact risk of the feature store per plant."""
    per_asset = wh["ml_feature_store"].groupBy("asset_id").agg(F.sum(F.col("downtime_impact_risk").cast("decimal(16,2)")).alias("r"))
    placed = per_asset.join(place_assets(wh.current_assets(), wh, ["plant_name"]), "asset_id")
    return placed.groupBy("plant_name").agg(F.sum("r").cast("double").alias("impact_risk")).orderBy(
        F.col("impact_risk").desc(), "plant_name")


def vibration_outliers(wh: Warehouse, k: float = 2.0) -> DataFrame:
    """Readings beyond k deviations of the asset's 7 days before."""
    return deviation_from_past(wh[TELEMETRY], 7, k).select(
        "telemetry_id", "asset_id", "recorded_at", F.col("vibration_mm_s").cast("double").alias("vibration_mm_s"),
        half_up(F.col("past_mean"), 4).alias("past_mean"), half_up(F.col("past_std"), 4).alias("past_std"))


def star_join_maintenance(wh: Warehouse) -> DataFrame:
    """Cost per plant, class, order type and craft: dimensions reached by the relationship list.

    The log is summed by its own keys before any dimension is joined.
    """
    cost = F.col("parts_cost") + F.col("labor_cost")
    sums = wh["fct_maintenance_log"].groupBy("asset_id", "wo_type_id", "technician_id").agg(
        F.sum(cost).alias("c"), F.count(F.lit(1)).alias("n"))
    joined = star_join(wh, "fct_maintenance_log", {
        "dim_plant": ["plant_name"], "dim_asset_class": ["class_name"], "dim_work_order_type": ["wo_type_name"],
        "dim_technician": ["craft"]}, rows=sums)
    return joined.groupBy("plant_name", "class_name", "wo_type_name", "craft").agg(
        F.sum("n").alias("orders"), F.sum("c").cast("double").alias("total_cost"))


def result_top10(wh: Warehouse) -> DataFrame:
    """First ten assets of the health list and how many follow."""
    rows = latest_health(wh).select("asset_id", F.col("latest_health_score").cast("double").alias("health"))
    return head_with_rest(rows, [F.col("health"), F.col("asset_id")])


def star_join_production(wh: Warehouse) -> DataFrame:
    """Output per plant and process type, by the relationship list."""
    sums = wh["fct_production_log"].groupBy("asset_id").agg(F.sum("units_produced").alias("u"), F.sum("units_scrapped").alias("s"))
    joined = star_join(wh.with_tables(dim_asset=wh.production_assets()), "fct_production_log",
                       {"dim_plant": ["plant_name"], "dim_process": ["process_type"]}, rows=sums)
    return joined.groupBy("plant_name", "process_type").agg(F.sum("u").alias("units_produced"), F.sum("s").alias("units_scrapped"))


def star_join_telemetry(wh: Warehouse) -> DataFrame:
    """Readings per line and class, by the relationship list."""
    sums = wh[TELEMETRY].groupBy("asset_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_anomalous").alias("a"))
    joined = star_join(wh, TELEMETRY, {"dim_line": ["line_name"], "dim_asset_class": ["class_name"]}, rows=sums)
    return joined.groupBy("line_name", "class_name").agg(F.sum("n").alias("readings"), F.sum("a").alias("anomalous"))


def star_join_parts(wh: Warehouse) -> DataFrame:
    """Parts cost per plant and maker of the part: the plant is reached through the work order."""
    sums = wh["fct_maintenance_parts_used"].groupBy("log_id", "material_id").agg(F.sum("total_cost").alias("c"))
    joined = star_join(wh, "fct_maintenance_parts_used", {"dim_plant": ["plant_name"], "dim_material": ["supplier_name"]}, rows=sums)
    return joined.groupBy("plant_name", "supplier_name").agg(F.sum("c").cast("double").alias("parts_cost"))


def star_join_budget(wh: Warehouse) -> DataFrame:
    """Budget per plant and year, by the relationship list."""
    joined = star_join(wh, "fct_budget", {"dim_plant": ["plant_name"]})
    return joined.groupBy("plant_name", "year").agg(F.sum("budget_amount").cast("double").alias("budget"))


def line_months(wh: Warehouse) -> DataFrame:
    """Maintenance, production and telemetry of every line and month in one row.

    A site that keeps the assets of production apart has them in ``dim_machine``: its part is taken along those.
    """
    log = FactPart("fct_maintenance_log", ("asset_id",), month_start(F.col("completed_date")), {
        "orders": F.count(F.lit(1)), "downtime_hours": F.sum("downtime_hours").cast("decimal(20,1)"), "failures": F.count_if("failure_flag")})
    output = FactPart("fct_production_log", ("asset_id",), month_start(F.col("production_date")), {
        "units_produced": F.sum("units_produced"), "units_scrapped": F.sum("units_scrapped")}, assets="production_assets")
    feed = FactPart(TELEMETRY, ("asset_id",), month_start(F.to_date("recorded_at")), {
        "readings": F.count(F.lit(1)), "anomalous": F.count_if("is_anomalous")})
    rows = drill_across(wh, [log, output, feed], {"dim_line": ["line_name"]})
    return rows.withColumn("downtime_hours", F.col("downtime_hours").cast("double"))
