"""Table catalogue: layer, column DDL, key and physical layout of every warehouse table.

DDL strings are handed straight to ``spark.read.schema`` / ``createDataFrame``, so the
types below are the contract between writers and readers.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class TableSpec:
    """Where a table lives, what it looks like and how its files are laid out."""

    layer: str
    ddl: str
    key: tuple[str, ...] = ()
    partition_by: tuple[str, ...] = ()
    sort_by: tuple[str, ...] = ()


TABLES: dict[str, TableSpec] = {
    # Bronze: one JSON document per row, typed only when parsed.
    "raw_telemetry": TableSpec(
        "bronze", "raw_payload STRING, source_timestamp TIMESTAMP_NTZ, ingestion_timestamp TIMESTAMP"
    ),
    "raw_maintenance": TableSpec(
        "bronze", "log_data STRING, source_filename STRING, ingestion_timestamp TIMESTAMP"
    ),
    "raw_equipment": TableSpec("bronze", "equipment_data STRING, ingestion_timestamp TIMESTAMP"),
    # Silver dimensions.
    "dim_date": TableSpec(
        "silver",
        "date_sk INT, full_date DATE, day_of_week STRING, month_name STRING, quarter INT, year INT",
        key=("date_sk",),
    ),
    "dim_plant": TableSpec(
        "silver", "plant_id INT, plant_name STRING, location STRING, plant_path STRING", key=("plant_id",)
    ),
    "dim_line": TableSpec(
        "silver",
        "line_id INT, plant_id INT, line_name STRING, hourly_revenue DECIMAL(10,2), line_path STRING",
        key=("line_id",),
    ),
    "dim_process": TableSpec(
        "silver",
        "process_id INT, process_nk STRING, process_name STRING, process_type STRING, line_id INT, "
        "process_path STRING, description STRING, is_active BOOLEAN",
        key=("process_id",),
    ),
    "dim_asset_class": TableSpec("silver", "asset_class_id INT, class_name STRING", key=("asset_class_id",)),
    "dim_asset": TableSpec(
        "silver",
        "asset_id BIGINT, asset_nk STRING, asset_name STRING, model STRING, oem_name STRING, process_id INT, "
        "process_sequence INT, asset_class_id INT, installation_date DATE, "
        "downtime_impact_per_hour DECIMAL(12,2), asset_path STRING, scd_start_date TIMESTAMP_NTZ, "
        "scd_end_date TIMESTAMP_NTZ, is_current BOOLEAN",
        key=("asset_id",),
        sort_by=("asset_id",),
    ),
    "dim_work_order_type": TableSpec(
        "silver", "wo_type_id INT, wo_type_name STRING, wo_type_code STRING", key=("wo_type_id",)
    ),
    "dim_sensor": TableSpec(
        "silver",
        "sensor_sk BIGINT, sensor_nk STRING, asset_id BIGINT, sensor_type STRING, units_of_measure STRING, "
        "sensor_path STRING",
        key=("sensor_sk",),
    ),
    "dim_technician": TableSpec(
        "silver",
        "technician_id BIGINT, employee_nk STRING, technician_name STRING, craft STRING, shift STRING, "
        "hire_date DATE, is_active BOOLEAN",
        key=("technician_id",),
    ),
    "dim_failure_code": TableSpec(
        "silver",
        "failure_code_id BIGINT, failure_hierarchy_1 STRING, failure_hierarchy_2 STRING, "
        "failure_hierarchy_3 STRING, failure_description STRING",
        key=("failure_code_id",),
    ),
    "dim_material": TableSpec(
        "silver",
        "material_id BIGINT, material_nk STRING, material_desc STRING, supplier_name STRING, "
        "unit_cost DECIMAL(10,2)",
        key=("material_id",),
    ),
    # Silver facts.
    "fct_asset_telemetry": TableSpec(
        "silver",
        "telemetry_id BIGINT, asset_id BIGINT, process_id INT, date_sk INT, recorded_at TIMESTAMP_NTZ, "
        "temperature_c DECIMAL(5,2), vibration_mm_s DECIMAL(5,2), pressure_psi DECIMAL(6,2), "
        "health_score DECIMAL(5,2), failure_probability DECIMAL(3,2), rul_days INT, is_anomalous BOOLEAN",
        key=("telemetry_id",),
        partition_by=("date_sk",),
        sort_by=("asset_id", "recorded_at"),
    ),
    "fct_maintenance_log": TableSpec(
        "silver",
        "log_id BIGINT, asset_id BIGINT, process_id INT, wo_type_id INT, action_date_sk INT, "
        "completed_date DATE, downtime_hours DECIMAL(5,1), parts_cost DECIMAL(10,2), "
        "labor_cost DECIMAL(10,2), failure_flag BOOLEAN, technician_id BIGINT, failure_code_id BIGINT, "
        "technician_notes STRING",
        key=("log_id",),
        partition_by=("action_date_sk",),
        sort_by=("asset_id", "completed_date"),
    ),
    "fct_production_log": TableSpec(
        "silver",
        "prod_log_id BIGINT, asset_id BIGINT, process_id INT, date_sk INT, production_date DATE, "
        "planned_runtime_hours DECIMAL(4,1), actual_runtime_hours DECIMAL(4,1), units_produced BIGINT, "
        "units_scrapped BIGINT",
        key=("prod_log_id",),
        partition_by=("date_sk",),
        sort_by=("asset_id", "production_date"),
    ),
    "fct_maintenance_parts_used": TableSpec(
        "silver",
        "log_id BIGINT, material_id BIGINT, quantity_used DECIMAL(8,2), total_cost DECIMAL(10,2)",
        key=("log_id", "material_id"),
    ),
    "fct_budget": TableSpec(
        "silver",
        "budget_id INT, plant_id INT, year INT, quarter INT, budget_type STRING, budget_amount DECIMAL(15,2)",
        key=("budget_id",),
    ),
    # Gold.
    "agg_asset_hourly_health": TableSpec(
        "gold",
        "hour_timestamp TIMESTAMP_NTZ, asset_id BIGINT, avg_temperature_c DOUBLE, max_vibration_mm_s DOUBLE, "
        "stddev_pressure_psi DOUBLE, latest_health_score DECIMAL(5,2), "
        "avg_failure_probability DECIMAL(3,2), min_rul_days INT, hour_date DATE",
        key=("asset_id", "hour_timestamp"),
        partition_by=("hour_date",),
        sort_by=("asset_id", "hour_timestamp"),
    ),
    "agg_asset_latest_health": TableSpec(
        "gold",
        "asset_id BIGINT, hour_timestamp TIMESTAMP_NTZ, latest_health_score DECIMAL(5,2), "
        "avg_failure_probability DECIMAL(3,2), min_rul_days INT, bucket INT",
        key=("asset_id",),
        partition_by=("bucket",),
        sort_by=("asset_id",),
    ),
    # What the next load of the feature store needs of all days up to as_of_sk.
    "ml_feature_state_asset": TableSpec(
        "gold", "asset_id BIGINT, last_pm DATE, last_failure DATE, as_of_sk INT", partition_by=("as_of_sk",), sort_by=("asset_id",)
    ),
    "ml_feature_state_maker": TableSpec(
        "gold", "oem_name STRING, observed BIGINT, failures BIGINT, as_of_sk INT", partition_by=("as_of_sk",)
    ),
    "ml_feature_store": TableSpec(
        "gold",
        "observation_date_sk INT, asset_id BIGINT, avg_temp_last_24h DOUBLE, vibration_stddev_7d DOUBLE, "
        "pressure_trend_7d DOUBLE, cycles_since_last_pm INT, days_since_last_failure INT, "
        "oem_failure_rate_est DOUBLE, downtime_impact_risk DECIMAL(12,2), failed_in_next_7_days BOOLEAN",
        key=("asset_id", "observation_date_sk"),
        partition_by=("observation_date_sk",),
        sort_by=("asset_id",),
    ),
    "message_feedback": TableSpec(
        "silver", "message_id STRING, user_id STRING, rating STRING, timestamp TIMESTAMP_NTZ", sort_by=("message_id", "timestamp")),
    "conversation_history": TableSpec(
        "silver",
        "conversation_id STRING, message_id STRING, user_id STRING, timestamp TIMESTAMP_NTZ, role STRING, "
        "content STRING, backend_used STRING, response_time_ms BIGINT, metadata STRING",
        key=("message_id",),
        sort_by=("conversation_id", "timestamp"),
    ),
}


@dataclass(frozen=True)
class Relationship:
    """A many-to-one edge: ``child.child_key`` points at ``parent.parent_key``."""

    child: str
    child_key: str
    parent: str
    parent_key: str


# The joins of the model.
RELATIONSHIPS: tuple[Relationship, ...] = (
    Relationship("dim_process", "line_id", "dim_line", "line_id"),
    Relationship("dim_asset", "process_id", "dim_process", "process_id"),
    Relationship("dim_asset", "asset_class_id", "dim_asset_class", "asset_class_id"),
    Relationship("dim_sensor", "asset_id", "dim_asset", "asset_id"),
    Relationship("dim_line", "plant_id", "dim_plant", "plant_id"),
    Relationship("fct_asset_telemetry", "asset_id", "dim_asset", "asset_id"),
    Relationship("fct_asset_telemetry", "process_id", "dim_process", "process_id"),
    Relationship("fct_asset_telemetry", "date_sk", "dim_date", "date_sk"),
    Relationship("fct_maintenance_log", "asset_id", "dim_asset", "asset_id"),
    Relationship("fct_maintenance_log", "process_id", "dim_process", "process_id"),
    Relationship("fct_maintenance_log", "wo_type_id", "dim_work_order_type", "wo_type_id"),
    Relationship("fct_maintenance_log", "technician_id", "dim_technician", "technician_id"),
    Relationship("fct_maintenance_log", "failure_code_id", "dim_failure_code", "failure_code_id"),
    Relationship("fct_maintenance_log", "action_date_sk", "dim_date", "date_sk"),
    Relationship("fct_maintenance_parts_used", "log_id", "fct_maintenance_log", "log_id"),
    Relationship("fct_maintenance_parts_used", "material_id", "dim_material", "material_id"),
    Relationship("fct_production_log", "asset_id", "dim_asset", "asset_id"),
    Relationship("fct_production_log", "process_id", "dim_process", "process_id"),
    Relationship("fct_production_log", "date_sk", "dim_date", "date_sk"),
    Relationship("fct_budget", "plant_id", "dim_plant", "plant_id"),
    Relationship("agg_asset_hourly_health", "asset_id", "dim_asset", "asset_id"),
    Relationship("ml_feature_store", "asset_id", "dim_asset", "asset_id"),
)
