"""Asset health, risk and tool queries on the hourly Gold table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantpulse.functions import bands
from plantpulse.functions.numeric import half_up
from plantpulse.operators.joins import keep_known, place_assets
from plantpulse.operators.latest import arg_max, first_rows, top_rows, total_of_listed
from plantpulse.operators.shares import against_prior_mean
from plantpulse.warehouse import Warehouse

GOLD = "agg_asset_hourly_health"
LATEST = "agg_asset_latest_health"
HEALTH_COLUMNS = ("latest_health_score", "avg_failure_probability", "min_rul_days")


def _d(name: str) -> Column:
    return F.col(name).cast("double").alias(name)


def latest_health(wh: Warehouse) -> DataFrame:
    """Last hourly row per asset, as the loads keep it: one row per asset is read, not the hours."""
    return wh[LATEST].select("asset_id", "hour_timestamp", *HEALTH_COLUMNS)


def latest_health_report(wh: Warehouse) -> DataFrame:
    return latest_health(wh).select("asset_id", "hour_timestamp", _d("latest_health_score"),
                                    _d("avg_failure_probability"), "min_rul_days")


def health_daily(wh: Warehouse, as_of: dt.datetime | str, days: int = 30) -> DataFrame:
    rows = wh.last_hours(GOLD, as_of, days * 24)
    return rows.groupBy(F.to_date("hour_timestamp").alias("health_date")).agg(
        F.sum("latest_health_score").alias("s"), F.count("latest_health_score").alias("n")).select(
        "health_date", half_up(F.col("s").cast("double") / F.col("n"), 4).alias("avg_health_score"))


def kpi_health_delta(wh: Warehouse, as_of: dt.datetime | str, days: int = 30) -> DataFrame:
    """Mean of the assets' latest health against the mean of the 7 days before the last."""
    now = latest_health(wh).agg(F.sum("latest_health_score").alias("s"), F.count("latest_health_score").alias("n"))
    prior = against_prior_mean(health_daily(wh, as_of, days), "health_date", "avg_health_score")
    enough = prior.filter(F.col("observations") >= 8).select("prior_mean").scalar()
    current = half_up(F.col("s").cast("double") / F.col("n"), 4)
    row = now.select(current.alias("current_health"), half_up(F.coalesce(enough, current), 4).alias("prior_week_health"))
    return row.withColumn("health_delta", half_up(F.col("current_health") - F.col("prior_week_health"), 4))


def asset_risk(wh: Warehouse) -> DataFrame:
    """Latest health of current assets with class, impact and expected daily loss."""
    assets = wh.current_assets().select("asset_id", "asset_name", "asset_class_id", "downtime_impact_per_hour")
    risk = bands.production_at_risk(F.col("avg_failure_probability"), F.col("downtime_impact_per_hour"))
    return (latest_health(wh).join(assets, "asset_id").join(wh["dim_asset_class"], "asset_class_id")
            .withColumn("production_at_risk", risk))


def asset_risk_latest(wh: Warehouse) -> DataFrame:
    return asset_risk(wh).select(
        "asset_id", "asset_name", "class_name", _d("downtime_impact_per_hour"), _d("avg_failure_probability"),
        _d("latest_health_score"), "min_rul_days", _d("production_at_risk"))


def production_at_risk(wh: Warehouse) -> DataFrame:
    return asset_risk(wh).agg(F.coalesce(F.sum("production_at_risk"), F.lit(0)).cast("double").alias("production_at_risk"),
                              F.count(F.lit(1)).alias("assets"))


def risk_by_class(wh: Warehouse) -> DataFrame:
    return asset_risk(wh).groupBy("class_name").agg(
        F.sum("production_at_risk").cast("double").alias("production_at_risk"))


def risk_matrix(wh: Warehouse, class_name: str) -> DataFrame:
    return asset_risk_latest(wh).filter(F.col("class_name") == class_name)


def highest_risk_asset(wh: Warehouse) -> DataFrame:
    """The asset with the most at risk, for every class in one pass."""
    best = arg_max(asset_risk(wh), ["class_name"], "production_at_risk", "asset_id",
                   ["asset_name", "min_rul_days", "avg_failure_probability"])
    return best.select("class_name", _d("production_at_risk"), "asset_id", "asset_name", "min_rul_days",
                       _d("avg_failure_probability"))


def asset_hierarchy(wh: Warehouse) -> DataFrame:
    assets = wh.current_assets().join(wh["dim_asset_class"], "asset_class_id")
    columns = ["asset_name", "model", "oem_name", "class_name", "process_name", "line_name", "plant_name"]
    return place_assets(assets, wh, columns).orderBy(
        "plant_name", "line_name", "process_name", "asset_name", "asset_id")


def asset_details(wh: Warehouse, asset_id: int | None = None) -> DataFrame:
    """Attributes, place and (if any) latest health of one current asset, or of all."""
    assets, latest = wh.current_assets(), latest_health(wh).drop("hour_timestamp")
    if asset_id is not None:
        assets, latest = (t.filter(F.col("asset_id") == asset_id) for t in (assets, latest))
    columns = ["asset_name", "model", "oem_name", "installation_date", "downtime_impact_per_hour", "class_name",
               "process_name", "line_name", "plant_name"]
    placed = place_assets(assets.join(wh["dim_asset_class"], "asset_class_id"), wh, columns)
    return placed.join(latest, "asset_id", "left").select(
        "asset_id", *[_d(c) if c == "downtime_impact_per_hour" else c for c in columns],
        _d("latest_health_score"), _d("avg_failure_probability"), "min_rul_days",
        bands.health_band(F.col("latest_health_score")).alias("health_band"))


def asset_health(wh: Warehouse, limit: int = 10, snapshot: bool = True, asset_id: int | None = None) -> DataFrame:
    """Assets by failure probability.

    ``snapshot`` keeps the latest hour of each asset first; without it every hourly row
    competes and an asset can appear more than once.
    """
    rows = latest_health(wh) if snapshot else wh[GOLD].select("asset_id", "hour_timestamp", *HEALTH_COLUMNS)
    if asset_id is not None:
        rows = latest_health(wh).filter(F.col("asset_id") == asset_id)
    assets = wh.current_assets().select("asset_id", "asset_name", "model", "oem_name", "downtime_impact_per_hour")
    out = rows.join(assets, "asset_id").select(
        "asset_id", "hour_timestamp", "asset_name", "model", "oem_name", _d("latest_health_score"),
        _d("avg_failure_probability"), _d("downtime_impact_per_hour"),
        bands.tool_health_status(F.col("latest_health_score")).alias("status"))
    return top_rows(out, [F.col("avg_failure_probability").desc(), F.col("asset_id"), F.col("hour_timestamp")], limit)


def _at_risk(wh: Warehouse, snapshot: bool, where: Column) -> DataFrame:
    """Health rows meeting ``where``, with asset attributes.

    The hourly form filters before the join; the snapshot form must pick the latest row
    first, because an older row that meets the condition is not the asset's state.
    """
    rows = latest_health(wh) if snapshot else wh[GOLD].select("asset_id", "hour_timestamp", *HEALTH_COLUMNS)
    assets = wh.current_assets().select("asset_id", "asset_name", "model", "downtime_impact_per_hour")
    return rows.filter(where).join(assets, "asset_id")


def failure_prediction(wh: Warehouse, days_ahead: int = 7, threshold: float = 0.5, limit: int = 10,
                       snapshot: bool = True) -> DataFrame:
    """Rows above the probability threshold and within the horizon, riskiest first.

    ``total_risk_value`` is the sum of probability x impact over the listed rows.
    """
    where = (F.col("avg_failure_probability") > F.lit(threshold).cast("decimal(3,2)")) & (F.col("min_rul_days") <= days_ahead)
    order = [F.col("avg_failure_probability").desc(), F.col("asset_id"), F.col("hour_timestamp")]
    top = top_rows(_at_risk(wh, snapshot, where), order, limit)
    value = F.col("avg_failure_probability") * F.col("downtime_impact_per_hour")
    return total_of_listed(top, value, "total_risk_value").select(
        "asset_id", "hour_timestamp", "asset_name", "model", _d("avg_failure_probability"), "min_rul_days",
        _d("downtime_impact_per_hour"), bands.risk_level(F.col("avg_failure_probability").cast("double")).alias("risk_level"),
        _d("total_risk_value"))


def downtime_risk(wh: Warehouse, horizon_days: int = 30, limit: int = 10, snapshot: bool = True) -> DataFrame:
    """Expected loss per day and over the horizon; the portfolio total covers the listed rows."""
    daily = bands.production_at_risk(F.col("avg_failure_probability"), F.col("downtime_impact_per_hour"))
    rows = _at_risk(wh, snapshot, F.col("min_rul_days") <= horizon_days).withColumn("daily", daily)
    top = top_rows(rows, [F.col("daily").desc(), F.col("asset_id"), F.col("hour_timestamp")], limit)
    return total_of_listed(top, F.col("daily") * horizon_days, "portfolio_risk").select(
        "asset_id", "hour_timestamp", "asset_name", _d("downtime_impact_per_hour"), _d("avg_failure_probability"),
        "min_rul_days", F.col("daily").cast("double").alias("daily_risk_value"),
        (F.col("daily") * horizon_days).cast("double").alias("period_risk"), _d("portfolio_risk"))


def triage(wh: Warehouse, classes: Sequence[str] | None = None, threshold: float = 80) -> DataFrame:
    """Assets of the given classes at or below a health threshold, worst first."""
    rows = asset_risk_latest(wh).filter(F.col("latest_health_score") <= threshold)
    if classes is not None:
        rows = rows.filter(F.col("class_name").isin(list(classes)))
    return rows.select("asset_id", "class_name", "latest_health_score", "min_rul_days").orderBy(
        "latest_health_score", "asset_id")


def work_order_candidates(wh: Warehouse, as_of: dt.date | str, threshold: float = 0.1, days_ahead: int = 30) -> DataFrame:
    """One proposed work order per at-risk asset, with an id that is the same on every run."""
    where = (F.col("avg_failure_probability") > F.lit(threshold).cast("decimal(3,2)")) & (F.col("min_rul_days") <= days_ahead)
    day = str(as_of).replace("-", "")
    probability = F.col("avg_failure_probability").cast("double")
    return _at_risk(wh, True, where).select(
        F.concat(F.lit(f"WO-{day}-"), F.col("asset_id").cast("string")).alias("work_order_id"), "asset_id", "asset_name",
        F.when(probability > 0.8, "Critical").when(probability > 0.6, "High").otherwise("Medium").alias("priority"),
        F.when(F.col("min_rul_days") <= 7, "Emergency Repair").otherwise("Preventive Maintenance").alias("work_type"))


def pm_schedule(wh: Warehouse, requested: DataFrame, schedule_date: dt.date | str) -> DataFrame:
    """Schedule ids for the requested assets that exist and are current."""
    day = str(schedule_date).replace("-", "")
    assets = wh.current_assets().select("asset_id", "asset_name")
    valid = keep_known(requested.select("asset_id").distinct(), assets, "asset_id")
    return valid.join(assets, "asset_id").select(
        F.concat(F.lit(f"PM-{day}-"), F.col("asset_id").cast("string")).alias("schedule_id"), "asset_id", "asset_name")


def maintenance_alerts(wh: Warehouse, below: float = 50, shown: int = 5) -> DataFrame:
    """Per plant: how many assets are critical, and the first ids of them."""
    critical = latest_health(wh).filter(F.col("latest_health_score") < below)
    placed = place_assets(wh.current_assets(), wh, ["plant_name"])
    rows = critical.join(placed, "asset_id").select("plant_name", "asset_id")
    counts = rows.groupBy("plant_name").agg(F.count(F.lit(1)).alias("critical_assets"))
    first = (first_rows(rows, ["plant_name"], [F.col("asset_id")], shown)
             .groupBy("plant_name").agg(F.array_sort(F.collect_list("asset_id")).alias("ids")))
    return counts.join(first, "plant_name").select(
        "plant_name", "critical_assets", F.array_join(F.col("ids").cast("array<string>"), ",").alias("first_assets"))
