"""A warehouse written to disk in the declared schemas, opened again and queried."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plantpulse.plans import assets, conversations, gold, health, ingest, maintenance, production, questions
from plantpulse.schemas import RELATIONSHIPS, TABLES
from plantpulse.sources.tables import append_table, conform, read_table
from plantpulse.warehouse import Warehouse

WRITTEN = ["dim_plant", "dim_line", "dim_process", "dim_asset_class", "dim_work_order_type", "dim_sensor", "dim_technician",
           "dim_failure_code", "dim_material", "dim_asset", "fct_asset_telemetry", "fct_maintenance_log", "fct_production_log",
           "fct_maintenance_parts_used", "fct_budget", "agg_asset_hourly_health", "conversation_history",
           "ml_feature_store", "raw_telemetry", "raw_maintenance", "raw_equipment"]


@pytest.fixture(scope="module")
def opened(spark, sample, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("warehouse"))
    source = {name: sample[name] for name in WRITTEN}
    source["fct_production_log"] = source["fct_production_log"].withColumn(
        "date_sk", F.expr("year(production_date) * 100 + month(production_date)"))  # monthly folders keep the test small
    source["fct_maintenance_log"] = source["fct_maintenance_log"].withColumn("action_date_sk", F.year("completed_date"))
    source["agg_asset_hourly_health"] = source["agg_asset_hourly_health"].withColumn("hour_date", F.to_date("hour_timestamp"))
    for name, df in source.items():
        append_table(df.coalesce(1), root, name)
    wh = Warehouse.open(spark, root)
    wh._time_columns["fct_production_log"] = (("production_date", "date"),)
    wh._time_columns["fct_maintenance_log"] = (("completed_date", "date"),)
    return wh


def test_relationships_name_declared_columns():
    columns = {name: {c.split()[0] for c in spec.ddl.split(", ")} for name, spec in TABLES.items()}
    for edge in RELATIONSHIPS:
        assert edge.child_key in columns[edge.child] and edge.parent_key in columns[edge.parent]
        assert (edge.parent_key,) == TABLES[edge.parent].key
    assert len(RELATIONSHIPS) == 22


def test_round_trip_keeps_rows_and_types(opened, sample):
    for name in ("fct_asset_telemetry", "fct_maintenance_parts_used", "agg_asset_hourly_health"):
        assert opened[name].count() == sample[name].count()
    assert opened["fct_asset_telemetry"].schema["health_score"].dataType.simpleString() == "decimal(5,2)"


def test_bronze_is_read_from_its_tables(opened, sample):
    for plan in (ingest.bronze_telemetry, ingest.bronze_rejects, ingest.bronze_maintenance, ingest.bronze_equipment,
                 ingest.maintenance_rejects, ingest.equipment_rejects, ingest.unknown_devices,
                 lambda wh: ingest.silver_readings(wh, {"view": "temperature_c"})):
        assert plan(opened).count() == plan(sample).count()


def test_loading_a_range_again_gives_one_full_build(spark, opened, tmp_path):
    root = str(tmp_path)
    for first, last in (("2024-01-01", "2024-01-12"), ("2024-01-10", "2024-01-31"), ("2024-01-10", "2024-01-31")):
        gold.load_hourly_health(opened, root, first, last)
        gold.load_feature_store(opened, root, first, last)
    for name, whole in (("agg_asset_hourly_health", gold.hourly_health(opened["fct_asset_telemetry"])), ("ml_feature_store", gold.feature_store(opened))):
        loaded = read_table(spark, root, name).select(*whole.columns)
        assert loaded.count() == whole.count()
        assert loaded.exceptAll(conform(whole, name).select(*whole.columns)).count() == 0


def test_gold_questions_do_not_read_telemetry(opened):
    for plan in (questions.cycles_of_failed, questions.impact_risk_by_plant, lambda wh: questions.predicted_failures(wh, "2024-01-20")):
        assert "fct_asset_telemetry" not in plan(opened)._jdf.queryExecution().executedPlan().toString()


def test_latest_health_is_the_same(opened, sample):
    a, b = (sorted(map(tuple, health.latest_health_report(wh).collect())) for wh in (opened, sample))
    assert a == b


PLANS = {
    "oee_by_plant": production.oee_by_plant,
    "oee_daily_plant": lambda wh: production.oee_daily_plant(wh, "2001-08-01"),
    "plant_trend": lambda wh: production.plant_trend(wh, "2001-08-01"),
    "risk_by_class": health.risk_by_class,
    "asset_details": lambda wh: health.asset_details(wh, 7),
    "failure_prediction": lambda wh: health.failure_prediction(wh, 30, 0.0),
    "factory_tree": lambda wh: assets.factory_tree(wh, "ASIA"),
    "scd2": assets.scd2_point_in_time,
    "feature_store": gold.feature_store,
    "maintenance_history": lambda wh: maintenance.maintenance_history(wh, "2001-08-01", 365),
    "budget_yoy": lambda wh: maintenance.budget_yoy(wh, "OpEx Maintenance"),
    "star_join": questions.star_join_maintenance,
    "vibration_outliers": questions.vibration_outliers,
    "overdue": lambda wh: maintenance.overdue_preventive(wh, "2024-01-30"),
    "conversations": lambda wh: conversations.alternating_roles(
        conversations.with_turns(wh["conversation_history"]), F.lit(True)),
}


@pytest.mark.parametrize("name", sorted(PLANS))
def test_plans_run_on_an_opened_warehouse(opened, name):
    rows = PLANS[name](opened).collect()
    assert rows or name == "vibration_outliers"


def test_turns_follow_time(opened, sample):
    made = conversations.with_turns(opened["conversation_history"]).select("message_id", "turn").collect()
    want = {r.message_id: r.turn for r in sample["conversation_history"].select("message_id", "turn").collect()}
    assert {r.message_id: r.turn for r in made} == want


def test_failure_prediction_can_be_empty(opened):
    assert health.failure_prediction(opened, 1, 0.99).count() == 0
