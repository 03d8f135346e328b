"""Named queries over the sample tables: name -> function of (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantpulse.bindings import (METRIC_EVENTS, OPERATIONS_TODAY, ROTATING_CLASS, TELEMETRY_NOW, TELEMETRY_TODAY,
                                 bind_sample)
from plantpulse.plans import assets, gold, health, ingest
from plantpulse.plans import conversations as conv
from plantpulse.plans import maintenance as mnt
from plantpulse.plans import production as prod
from plantpulse.plans import questions as ask
from plantpulse.functions.python_functions import health_band_udf, oee_by_group
from plantpulse.plans.learning import failure_scores, score_facts
from plantpulse.sources.shared import shared_dir
from plantpulse.sources.bronze import stamp_ingestion
from plantpulse.sources.tables import append_table, load_conversation, overwrite_table, preview_text, read_table, save_messages
from plantpulse.streaming.sample import STREAMS
from plantpulse.warehouse import Warehouse

Query = Callable[[SparkSession, str], DataFrame]


def _on_sample(plan: Callable[[Warehouse], DataFrame]) -> Query:
    return lambda spark, sf_dir: plan(bind_sample(spark, sf_dir))


PRODUCTION: dict[str, Callable[[Warehouse], DataFrame]] = {
    "oee_by_plant": prod.oee_by_plant,
    "oee_by_line": prod.oee_by_line,
    "oee_rollup": prod.oee_rollup,
    "oee_daily_enterprise": lambda wh: prod.oee_daily_enterprise(wh, OPERATIONS_TODAY),
    "oee_daily_plant": lambda wh: prod.oee_daily_plant(wh, OPERATIONS_TODAY),
    "plant_current": lambda wh: prod.plant_current(wh, OPERATIONS_TODAY),
    "kpi_oee_delta": lambda wh: prod.kpi_oee_delta(wh, OPERATIONS_TODAY),
    "plant_trend": lambda wh: prod.plant_trend(wh, OPERATIONS_TODAY),
    "oee_mean_of_ratios": lambda wh: prod.oee_mean_of_ratios(wh, OPERATIONS_TODAY),
    "scrap_rate": prod.scrap_rate,
    "runtime_by_plant": prod.runtime_by_plant,
    "availability_by_line": prod.availability_by_line,
    "uptime_by_process": lambda wh: prod.uptime_by_process(wh, "ASIA"),
    "units_by_line": lambda wh: prod.units_by_line(wh, OPERATIONS_TODAY),
    "units_per_hour_by_process_type": prod.units_per_hour_by_process_type,
    "weekly_production": lambda wh: prod.weekly_production(wh, "EUROPE"),
    "line_revenue": prod.line_revenue,
}

HEALTH: dict[str, Callable[[Warehouse], DataFrame]] = {
    "latest_health": health.latest_health_report,
    "health_daily": lambda wh: health.health_daily(wh, TELEMETRY_NOW),
    "kpi_health_delta": lambda wh: health.kpi_health_delta(wh, TELEMETRY_NOW),
    "asset_risk_latest": health.asset_risk_latest,
    "production_at_risk": health.production_at_risk,
    "risk_by_class": health.risk_by_class,
    "risk_matrix": lambda wh: health.risk_matrix(wh, ROTATING_CLASS),
    "highest_risk_asset": health.highest_risk_asset,
    "asset_hierarchy": health.asset_hierarchy,
    "asset_details": health.asset_details,
    "asset_health_snapshot": health.asset_health,
    "asset_health_hourly": lambda wh: health.asset_health(wh, snapshot=False),
    "failure_prediction_hourly": lambda wh: health.failure_prediction(wh, 30, 0.5, snapshot=False),
    "failure_prediction_snapshot": lambda wh: health.failure_prediction(wh, 30, 0.1),
    "downtime_risk_hourly": lambda wh: health.downtime_risk(wh, snapshot=False),
    "downtime_risk_snapshot": health.downtime_risk,
    "triage": lambda wh: health.triage(wh, ["MACHINERY", "BUILDING", "FURNITURE"], 85),
    "work_order_candidates": lambda wh: health.work_order_candidates(wh, TELEMETRY_TODAY),
    "pm_schedule": lambda wh: health.pm_schedule(wh, wh.service_log().filter("wo_type_id = 1"), "2024-02-01"),
    "alerts": lambda wh: health.maintenance_alerts(wh, below=85),
}

ASSETS: dict[str, Callable[[Warehouse], DataFrame]] = {
    "plants": assets.plants,
    "lines": lambda wh: assets.lines(wh, "ASIA"),
    "line_assets": lambda wh: assets.line_assets(wh, "NATION_7"),
    "telemetry_pivot": assets.telemetry_pivot,
    "latest_telemetry": assets.latest_telemetry,
    "latest_prediction": assets.latest_prediction,
    "sensor_status": assets.sensor_status,
    "asset_status": assets.asset_status,
    "rule_scores": lambda wh: assets.rule_scores(wh, "2023-09-01"),
    "anomaly_flags": lambda wh: assets.anomaly_flags(wh, ROTATING_CLASS),
    "sensor_readings": lambda wh: assets.sensor_readings(wh, 7, "2024-01-10", "2024-01-25"),
    "sensor_readings_by_metric": lambda wh: assets.sensor_readings_by_metric(wh, "2024-01-10", "2024-01-25"),
    "latest_reading_per_sensor": assets.latest_reading_per_sensor,
    "out_of_range": lambda wh: assets.out_of_range(wh, TELEMETRY_NOW),
    "hot_sensors": lambda wh: assets.hot_sensors(wh, TELEMETRY_NOW),
    "hot_sensors_compared": lambda wh: assets.hot_sensors_compared(wh, TELEMETRY_NOW),
    "hot_sensors_approx": lambda wh: assets.hot_sensors_approx(wh, TELEMETRY_NOW),
    "anomaly_sessions": assets.anomaly_sessions,
    "scd2_point_in_time": assets.scd2_point_in_time,
    "flow_edges": assets.flow_edges,
    "process_edges": assets.process_edges,
    "path_levels": assets.path_levels,
    "factory_tree": assets.factory_tree,
    "factory_tree_back": lambda wh: assets.tree_read_back(assets.factory_tree(wh)),
    "tree_counts": assets.tree_counts,
    "temperature_before_hours": assets.temperature_before_hours,
    "sketches_compared": lambda wh: assets.sketches_compared(
        wh, [("2024-01-01", "2024-01-31"), ("2024-01-05", "2024-01-11"), ("2024-01-20", "2024-01-20")]),
    "repeated_positions": assets.repeated_positions,
}

TELEMETRY = "fct_asset_telemetry"


def _plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, for results that are compared by value."""
    return df.select(*[F.col(f.name).cast("double").alias(f.name) if f.dataType.typeName() == "decimal" else f.name
                       for f in df.schema])


# The sample's days as loads see them: most of the month, a day by itself, the rest, and two days once more.
LOADS = (("2024-01-01", "2024-01-20"), ("2024-01-21", "2024-01-21"), ("2024-01-22", "2024-01-31"), ("2024-01-21", "2024-01-22"))


def _loaded(wh: Warehouse, load: Callable[[Warehouse, str, str, str], None], name: str) -> DataFrame:
    """The table that one load after the other leaves."""
    root = shared_dir(wh.spark, "loads")
    for first, last in LOADS:
        load(wh, root, first, last)
    return _plain(read_table(wh.spark, root, name))


def _written_days(wh: Warehouse) -> DataFrame:
    """Readings appended in two goes, a day overwritten with half of its rows, three days read: their rows and folders."""
    root, rows = shared_dir(wh.spark, "written"), wh[TELEMETRY]
    for k in (0, 1):
        append_table(rows.filter(F.col("telemetry_id") % 2 == k), root, TELEMETRY)
    overwrite_table(rows.filter((F.col("date_sk") == 20240111) & (F.col("telemetry_id") % 2 == 0)), root, TELEMETRY)
    read = Warehouse.open(wh.spark, root).between(TELEMETRY, "2024-01-10", "2024-01-12")
    told = read.select("date_sk", F.regexp_extract(F.input_file_name(), "date_sk=([0-9]+)", 1).alias("folder"))
    return told.groupBy("date_sk").agg(F.count("*").alias("readings"), F.count_distinct("folder").alias("folders"))


def _text_preview(wh: Warehouse) -> DataFrame:
    path = shared_dir(wh.spark, "text")
    wh["dim_line"].select("line_name").orderBy("line_name").coalesce(1).write.text(path)
    return preview_text(wh.spark, path, 5)


def _conversation_reloaded(wh: Warehouse) -> DataFrame:
    """Messages saved in two goes, the last three of one conversation loaded."""
    root = shared_dir(wh.spark, "messages")
    for k in (0, 1):
        save_messages(wh[MESSAGES].filter(F.col("turn") % 2 == k), root)
    return load_conversation(wh.spark, root, "7", last=3).select("message_id", "role", "content")


GOLD: dict[str, Callable[[Warehouse], DataFrame]] = {
    "hourly_health": lambda wh: _plain(wh["agg_asset_hourly_health"]),
    "hourly_latest_by_time": lambda wh: _plain(gold.hourly_latest_by_time(wh[TELEMETRY])),
    "daily_observations": lambda wh: gold.daily_observations(wh[TELEMETRY]),
    "feature_temp_24h": lambda wh: gold.feature_temp_24h(wh[TELEMETRY]),
    "feature_vibration_7d": lambda wh: gold.feature_vibration_7d(wh[TELEMETRY]),
    "feature_pressure_trend": lambda wh: gold.feature_pressure_trend(wh[TELEMETRY]),
    "feature_days_since": lambda wh: gold.feature_days_since(wh[TELEMETRY], wh.service_log()),
    "label_next_7d": lambda wh: gold.label_next_days(wh[TELEMETRY], wh.service_log()),
    "feature_store": gold.feature_store,
    "feature_store_loaded": lambda wh: _loaded(wh, gold.load_feature_store, "ml_feature_store"),
    "latest_health_merged": lambda wh: _loaded(wh, gold.load_latest_health, "agg_asset_latest_health").drop("bucket"),
    "bronze_parse": lambda wh: ingest.bronze_telemetry(wh, ("event_id", "source_timestamp")),
    "bronze_rejects": lambda wh: ingest.bronze_rejects(wh, ("event_id",)).select("event_id", "reject_reason"),
    "silver_readings": lambda wh: ingest.silver_readings(wh, METRIC_EVENTS),
    "unknown_devices": ingest.unknown_devices,
    "bronze_maintenance": ingest.bronze_maintenance,
    "bronze_equipment": ingest.bronze_equipment,
    "asset_versions_built": ingest.asset_versions_built,
    "asset_versions_merged": lambda wh: ingest.asset_versions_merged(wh, "2023-08-15 00:00:00"),
    "maintenance_rejects": lambda wh: ingest.maintenance_rejects(wh).groupBy("reject_reason").agg(F.count("*").alias("messages")),
    "equipment_rejects": lambda wh: ingest.equipment_rejects(wh).groupBy("reject_reason").agg(F.count("*").alias("messages")),
    "ingestion_stamps": lambda wh: stamp_ingestion(wh["raw_telemetry"]).agg(
        F.count("*").alias("messages"), F.count("ingestion_timestamp").alias("stamped")),
    "written_days": _written_days,
    "text_preview": _text_preview,
    "variant_fields": ingest.variant_fields,
    "variant_values": ingest.variant_values,
    "bronze_to_wide": lambda wh: ingest.bronze_to_wide(wh, METRIC_EVENTS),
    "date_dimension": ingest.date_dimension,
    "spine_gaps": ingest.spine_gaps,
    "hour_gaps": ingest.hour_gaps,
    "dq_keys": ingest.dq_keys,
    "dq_orphans": ingest.dq_orphans,
    "dq_all_keys": ingest.dq_all_keys,
    "dq_all_references": ingest.dq_all_references,
    "dq_ranges": ingest.dq_ranges,
    "dq_failure_codes": ingest.dq_failure_codes,
    "dq_parts_cost": ingest.dq_parts_cost,
}

MAINTENANCE: dict[str, Callable[[Warehouse], DataFrame]] = {
    "maintenance_cost_by_type": mnt.maintenance_cost_by_type,
    "maintenance_history": lambda wh: mnt.maintenance_history(wh, OPERATIONS_TODAY),
    "maintenance_history_asset": lambda wh: mnt.maintenance_history_asset(wh, 7, "1996-01-01", "2000-12-31"),
    "maintenance_summary": lambda wh: mnt.maintenance_summary(wh, "2000-01-01", "2000-12-31"),
    "maintenance_roi": mnt.maintenance_roi,
    "technician_workload": mnt.technician_workload,
    "technician_units": lambda wh: mnt.technician_units(wh, 2000),
    "top_technician": lambda wh: mnt.top_technician(wh, 2000),
    "labor_by_craft": mnt.labor_by_craft,
    "activities_by_shift": mnt.activities_by_shift,
    "evening_shift_orders": lambda wh: mnt.evening_shift_orders(wh, OPERATIONS_TODAY),
    "technician_type_matrix": mnt.technician_type_matrix,
    "prevention_ratio": mnt.prevention_ratio,
    "emergency_orders": lambda wh: mnt.emergency_orders(wh, OPERATIONS_TODAY),
    "downtime_by_type": mnt.downtime_by_type,
    "planned_unplanned_downtime": mnt.planned_unplanned_downtime,
    "planned_unplanned_ratio": mnt.planned_unplanned_ratio,
    "failures_vs_preventive": mnt.failures_vs_preventive,
    "downtime_by_line": lambda wh: mnt.downtime_by_line(wh, OPERATIONS_TODAY),
    "downtime_in_month": lambda wh: mnt.downtime_in_month(wh, "2000-09-01", "2000-09-30"),
    "top_failure_codes": lambda wh: mnt.top_failure_codes(wh, 2000),
    "failure_hierarchy": mnt.failure_hierarchy,
    "failure_rate_by_process": mnt.failure_rate_by_process,
    "cost_by_process": lambda wh: mnt.cost_by_process(wh, "2001-04-01", "2001-06-30"),
    "downtime_impact_by_plant": mnt.downtime_impact_by_plant,
    "orders_by_asset_class": mnt.orders_by_asset_class,
    "emergency_mom": mnt.emergency_mom,
    "cost_by_quarter": mnt.cost_by_quarter,
    "costliest_quarter": mnt.costliest_quarter,
    "top_parts": mnt.top_parts,
    "parts_cost_by_type": lambda wh: mnt.parts_cost_by_type(wh, "2000-01-01", "2000-12-31"),
    "parts_per_event": mnt.parts_per_event,
    "supplier_max_cost": mnt.supplier_max_cost,
    "spend_on_kind": lambda wh: mnt.spend_on_kind(wh, "PROMO-"),
    "usage_rate": mnt.usage_rate,
    "bill_of_parts": lambda wh: mnt.bill_of_parts(wh, mnt.parts_rules(wh.spark)),
    "budget_total": lambda wh: mnt.budget_total(wh, "OpEx Maintenance", 2000, 3),
    "budget_share": lambda wh: mnt.budget_share(wh, 2000, "OpEx Maintenance"),
    "budget_type_share": lambda wh: mnt.budget_type_share(wh, 2000),
    "budget_yoy": lambda wh: mnt.budget_yoy(wh, "OpEx Maintenance"),
    "budget_spent": lambda wh: mnt.budget_spent(wh, OPERATIONS_TODAY),
    "maintenance_calendar": lambda wh: mnt.maintenance_calendar(wh, "2024-02-01", "2024-03-02"),
    "actual_runtime": mnt.actual_runtime,
    "scrap_from_failures": mnt.scrap_from_failures,
    "volume_vs_maintenance": mnt.volume_vs_maintenance,
    "overdue_preventive": lambda wh: mnt.overdue_preventive(wh, TELEMETRY_TODAY, 10),
    "recent_by_asset": mnt.recent_by_asset,
}

QUESTIONS: dict[str, Callable[[Warehouse], DataFrame]] = {
    "health_by_oem": lambda wh: ask.health_by_oem(wh, TELEMETRY_NOW),
    "weak_assets": ask.weak_assets,
    "health_trend_plant": lambda wh: ask.health_trend_plant(wh, TELEMETRY_NOW, "AMERICA"),
    "health_by_plant": ask.health_by_plant,
    "health_by_line": ask.health_by_line,
    "flagged_assets": ask.flagged_assets,
    "lowest_life": ask.lowest_life,
    "metric_summary": lambda wh: ask.metric_summary(wh, TELEMETRY_NOW),
    "age_health_correlation": lambda wh: ask.age_health_correlation(wh, TELEMETRY_TODAY),
    "vibration_trend": lambda wh: ask.vibration_trend(wh, TELEMETRY_NOW, 7),
    "vibration_spread_of_class": lambda wh: ask.vibration_spread_of_class(wh, ROTATING_CLASS),
    "risk_trend_slope": lambda wh: ask.risk_trend_slope(wh, TELEMETRY_NOW),
    "probability_change": lambda wh: ask.probability_change(
        wh, ("2024-01-01", "2024-01-15"), ("2024-01-16", "2024-01-30")),
    "predicted_failures": lambda wh: ask.predicted_failures(wh, "2024-01-20"),
    "impact_below_health": ask.impact_below_health,
    "cycles_of_failed": ask.cycles_of_failed,
    "impact_risk_by_plant": ask.impact_risk_by_plant,
    "vibration_outliers": ask.vibration_outliers,
    "star_join_maintenance": ask.star_join_maintenance,
    "star_join_production": ask.star_join_production,
    "star_join_telemetry": ask.star_join_telemetry,
    "star_join_parts": ask.star_join_parts,
    "star_join_budget": ask.star_join_budget,
    "line_months": ask.line_months,
    "result_top10": ask.result_top10,
}

MESSAGES = "conversation_history"

CONVERSATIONS: dict[str, Callable[[Warehouse], DataFrame]] = {
    "conversation_reloaded": _conversation_reloaded,
    "conv_analytics": lambda wh: conv.conversation_analytics(wh[MESSAGES]),
    "conv_backends": lambda wh: conv.backend_distribution(wh[MESSAGES]),
    "conv_alternating": lambda wh: conv.alternating_roles(
        wh[MESSAGES].select("conversation_id", "turn", "role", "content"), F.col("turn") % 3 != 1),
    "conv_context": lambda wh: conv.context_window(wh[MESSAGES], max_messages=4, max_tokens=200),
    "response_type": lambda wh: conv.response_types(wh[MESSAGES]),
    "response_type_documents": lambda wh: conv.response_type_counts(wh["documents"], "text", ["lang"]),
    "feedback_summary": lambda wh: conv.feedback_summary(wh["feedback"], wh["documents"]),
    "conv_export_rows": lambda wh: conv.export_rows(wh[MESSAGES]),
    "conv_export_back": lambda wh: conv.export_read_back(conv.conversation_export(wh[MESSAGES])),
    "feedback_daily": lambda wh: conv.feedback_daily(wh["message_feedback"], wh[MESSAGES]),
    "conv_export": lambda wh: conv.conversation_export(wh[MESSAGES]),
    "last_user_message": lambda wh: conv.last_user_message(wh[MESSAGES]),
    "last_messages": lambda wh: conv.last_messages(wh[MESSAGES], 2),
}



def _oee_in_python(wh: Warehouse) -> DataFrame:
    daily = prod.by_place(wh, wh["fct_production_log"], ["plant_name"], ["production_date"])
    return oee_by_group(daily.select("plant_name", *[
        F.col(c).cast("double").alias(n) for c, n in zip(prod.SUMS, ("planned", "actual", "produced", "scrapped"))]))


PYTHON: dict[str, Callable[[Warehouse], DataFrame]] = {
    "oee_by_plant_python": _oee_in_python,
    "health_band_python": lambda wh: health.latest_health(wh).select(
        "asset_id", health_band_udf()(F.col("latest_health_score").cast("double")).alias("health_band")),
    "failure_scores": lambda wh: failure_scores(wh["ml_feature_store"], 20240120),
    "failure_score_facts": lambda wh: score_facts(failure_scores(wh["ml_feature_store"], 20240120)),
}

GROUPS = (PRODUCTION, HEALTH, ASSETS, GOLD, MAINTENANCE, QUESTIONS, CONVERSATIONS, PYTHON)


def queries() -> dict[str, Query]:
    batch = {name: _on_sample(plan) for group in GROUPS for name, plan in group.items()}
    return {**batch, **STREAMS}
