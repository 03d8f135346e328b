"""Production and OEE queries."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantpulse.functions import bands
from plantpulse.functions.dates import as_date
from plantpulse.functions.numeric import half_up, ratio, ratio_or_null
from plantpulse.operators.joins import place_assets
from plantpulse.operators.latest import top_rows
from plantpulse.operators.shares import against_prior_mean, growth, with_previous
from plantpulse.warehouse import Warehouse

Day = dt.date | str
SUMS = ("planned_runtime_hours", "actual_runtime_hours", "units_produced", "units_scrapped")


def summed(rows: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    """The four production sums per key; every OEE figure derives from them."""
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in SUMS])


def by_place(wh: Warehouse, rows: DataFrame, place: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Sums per place of the hierarchy (and further row keys).

    Production rows are summed per asset before the join, so the join and its shuffle see
    one row per asset (and key), not the log.
    """
    per_asset = summed(rows, ["asset_id", *keys])
    placed = place_assets(wh.production_assets(), wh, place)
    return summed(per_asset.join(placed, "asset_id"), [*place, *keys])


def plain_sums() -> list[Column]:
    """The sums for output: hours to four digits, whatever type they were summed in."""
    return [half_up(F.col(c), 4).alias(c) for c in SUMS[:2]] + [F.col(c).cast("bigint").alias(c) for c in SUMS[2:]]


def with_oee(sums: DataFrame, keys: Sequence[str], performance: float = bands.STANDARD_PERFORMANCE,
             keep_sums: bool = False) -> DataFrame:
    p, a, u, s = (F.col(c) for c in SUMS)
    return sums.select(
        *keys, *(plain_sums() if keep_sums else []), half_up(bands.availability(p, a), 6).alias("availability"),
        F.lit(performance).alias("performance"), half_up(bands.quality(u, s), 6).alias("quality"),
        half_up(bands.oee(p, a, u, s, performance), 6).alias("oee"))


def oee_by_plant(wh: Warehouse) -> DataFrame:
    return with_oee(by_place(wh, wh["fct_production_log"], ["plant_name"]), ["plant_name"]).orderBy(
        F.col("oee").desc(), "plant_name")


def oee_by_line(wh: Warehouse, plant_name: str | None = None) -> DataFrame:
    keys = ["plant_name", "line_name"]
    rows = by_place(wh, wh["fct_production_log"], keys)
    if plant_name is not None:
        rows = rows.filter(F.col("plant_name") == plant_name)
    return with_oee(rows, keys).orderBy("oee", "plant_name", "line_name")


def oee_rollup(wh: Warehouse) -> DataFrame:
    """Lines, plant subtotals and the grand total in one pass over the per-line sums."""
    lines = by_place(wh, wh["fct_production_log"], ["plant_name", "line_name"])
    levels = lines.rollup("plant_name", "line_name").agg(
        F.grouping_id().cast("int").alias("level"), *[F.sum(c).alias(c) for c in SUMS])
    return with_oee(levels, ["plant_name", "line_name", "level"])


def oee_daily_enterprise(wh: Warehouse, as_of: Day, days: int = 30) -> DataFrame:
    rows = wh.last_days("fct_production_log", as_of, days)
    return with_oee(summed(rows, ["production_date"]), ["production_date"], keep_sums=True)


def oee_daily_plant(wh: Warehouse, as_of: Day, days: int = 30) -> DataFrame:
    rows = wh.last_days("fct_production_log", as_of, days)
    keys = ["plant_name", "production_date"]
    return with_oee(by_place(wh, rows, ["plant_name"], ["production_date"]), keys, keep_sums=True)


def plant_current(wh: Warehouse, as_of: Day, days: int = 7) -> DataFrame:
    sums = by_place(wh, wh.last_days("fct_production_log", as_of, days), ["plant_name"])
    return sums.select("plant_name", *plain_sums())


def kpi_oee_delta(wh: Warehouse, as_of: Day, days: int = 30) -> DataFrame:
    """Latest day's OEE and its percent change against the mean of the 7 days before."""
    daily = oee_daily_enterprise(wh, as_of, days).select("production_date", "oee")
    row = against_prior_mean(daily, "production_date", "oee")
    delta = F.when(F.col("prior_mean") > 0, (F.col("current") - F.col("prior_mean")) / F.col("prior_mean") * 100)
    return row.select(F.coalesce("current", F.lit(0.0)).alias("current_oee"),
                      half_up(F.coalesce("prior_mean", F.lit(0.0)), 6).alias("prior_week_oee"),
                      half_up(F.coalesce(delta, F.lit(0.0)), 4).alias("oee_delta_percent"))


def plant_trend(wh: Warehouse, as_of: Day, days: int = 30, points: int = 14, current_days: int = 7) -> DataFrame:
    """Figures of the last days per plant with the direction of its last ``points`` daily values.

    Both come from one pass: the daily sums per plant are a handful of rows.
    """
    daily = by_place(wh, wh.last_days("fct_production_log", as_of, days), ["plant_name"], ["production_date"])
    p, a, u, s = (F.col(c) for c in SUMS)
    newest_first = Window.partitionBy("plant_name").orderBy(F.col("production_date").desc())
    ranked = daily.select("plant_name", "production_date", *SUMS, half_up(bands.oee(p, a, u, s), 6).alias("oee"),
                          F.row_number().over(newest_first).alias("n"))
    recent, tail = F.col("production_date") >= F.date_sub(as_date(as_of), current_days), F.col("n") <= points
    summary = ranked.groupBy("plant_name").agg(
        *[F.sum(F.when(recent, F.col(c))).alias(c) for c in SUMS], F.count_if(tail).alias("n"),
        F.max_by("oee", "production_date").alias("last"),
        F.min_by(F.when(tail, F.col("oee")), F.when(tail, F.col("production_date"))).alias("first"))
    trend = F.when((F.col("n") >= 2) & (F.col("last") > F.col("first")), "up").otherwise("down")
    current = summary.filter(p.isNotNull()).withColumn("trend", trend)
    return with_oee(current, ["plant_name", "trend"])


def oee_mean_of_ratios(wh: Warehouse, as_of: Day, days: int = 7, limit: int | None = 10) -> DataFrame:
    """Mean per-row ratios per asset and line; performance is units over hours x 100.

    A row whose base is zero has no ratio and is left out of that mean.
    """
    p, a, u, s = (F.col(c) for c in SUMS)
    rows = wh.last_days("fct_production_log", as_of, days)
    means = rows.groupBy("asset_id").agg(
        F.avg(ratio_or_null(a, p)).alias("av"),
        F.avg(ratio_or_null(u - s, u)).alias("qu"),
        F.avg(ratio_or_null(u, a * 100)).alias("pe"))
    placed = place_assets(wh.production_assets(), wh, ["asset_name", "line_name"])
    percent = half_up(F.col("av") * F.col("qu") * F.col("pe") * 100, 4)
    out = means.join(placed, "asset_id").select(
        "asset_id", "asset_name", "line_name", half_up(F.col("av"), 6).alias("availability"),
        half_up(F.col("qu"), 6).alias("quality_rate"), half_up(F.col("pe"), 6).alias("performance_rate"),
        percent.alias("oee_percent"), bands.oee_status(percent).alias("oee_status"))
    if limit is None:
        return out
    return top_rows(out, [F.col("availability").desc(), F.col("asset_id")], limit)


def scrap_rate(wh: Warehouse, limit: int = 10) -> DataFrame:
    """Assets by scrapped over produced units, highest first."""
    rate = summed(wh["fct_production_log"], ["asset_id"]).select(
        "asset_id", half_up(ratio(F.col("units_scrapped"), F.col("units_produced")), 8).alias("scrap_rate"))
    return top_rows(rate, [F.col("scrap_rate").desc(), F.col("asset_id")], limit)


def runtime_by_plant(wh: Warehouse) -> DataFrame:
    """Mean planned and actual hours of a production row, per plant."""
    per_asset = wh["fct_production_log"].groupBy("asset_id").agg(
        F.sum("planned_runtime_hours").alias("p"), F.sum("actual_runtime_hours").alias("a"), F.count(F.lit(1)).alias("n"))
    placed = place_assets(wh.production_assets(), wh, ["plant_name"])
    sums = per_asset.join(placed, "asset_id").groupBy("plant_name").agg(
        F.sum("p").alias("p"), F.sum("a").alias("a"), F.sum("n").alias("n"))
    return sums.select("plant_name", half_up(ratio(F.col("p"), F.col("n")), 4).alias("mean_planned_hours"),
                       half_up(ratio(F.col("a"), F.col("n")), 4).alias("mean_actual_hours"))


def availability_by_line(wh: Warehouse) -> DataFrame:
    """Lines ranked by availability."""
    rows = by_place(wh, wh["fct_production_log"], ["plant_name", "line_name"]).select(
        "plant_name", "line_name",
        half_up(ratio(F.col("actual_runtime_hours"), F.col("planned_runtime_hours")), 6).alias("availability"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("availability").desc(), F.col("line_name"))
    return rows.withColumn("rank_no", F.row_number().over(w).cast("bigint"))


def uptime_by_process(wh: Warehouse, plant_name: str) -> DataFrame:
    """Uptime of the processes of one plant. The plant filter reaches the dimension scans."""
    rows = by_place(wh, wh["fct_production_log"], ["plant_name", "process_name"])
    return rows.filter(F.col("plant_name") == plant_name).select(
        "process_name",
        half_up(ratio(F.col("actual_runtime_hours"), F.col("planned_runtime_hours")), 6).alias("uptime"))


def units_by_line(wh: Warehouse, as_of: Day, days: int = 30, line_name: str | None = None) -> DataFrame:
    rows = by_place(wh, wh.last_days("fct_production_log", as_of, days), ["line_name"])
    if line_name is not None:
        rows = rows.filter(F.col("line_name") == line_name)
    return rows.select("line_name", F.col("units_produced").cast("bigint").alias("units_produced"))


def units_per_hour_by_process_type(wh: Warehouse) -> DataFrame:
    rows = by_place(wh, wh["fct_production_log"], ["process_type"])
    return rows.select("process_type", half_up(
        ratio(F.col("units_produced"), F.col("actual_runtime_hours")), 4).alias("units_per_hour"))


def weekly_production(wh: Warehouse, plant_name: str) -> DataFrame:
    """Units per week (Monday) of one plant with the change against the week before."""
    weekly = wh["fct_production_log"].withColumn("week_start", F.date_sub(
        F.col("production_date"), F.weekday("production_date")))
    rows = by_place(wh, weekly, ["plant_name"], ["week_start"]).filter(F.col("plant_name") == plant_name)
    before = with_previous(rows, "units_produced", "week_start", "previous", F.date_sub("week_start", 7), ["plant_name"])
    return before.select("week_start", F.col("units_produced").cast("bigint").alias("units_produced"),
                         growth(F.col("units_produced"), F.col("previous")).alias("change"))


def line_revenue(wh: Warehouse) -> DataFrame:
    """Hourly revenue of each line and what its running hours brought in."""
    hours = by_place(wh, wh["fct_production_log"], ["line_name", "hourly_revenue"])
    return hours.select("line_name", F.col("hourly_revenue").cast("double").alias("hourly_revenue"), half_up(
        F.col("actual_runtime_hours").cast("double") * F.col("hourly_revenue").cast("double"), 2).alias("revenue"))
