"""Bronze feeds, calendar, spines and data-quality reports."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantpulse.functions.dates import as_ntz, hour_start, wall_micros
from plantpulse.operators import quality
from plantpulse.operators.versions import merge_versions, versions_of
from plantpulse.schemas import RELATIONSHIPS, TABLES
from plantpulse.sources import bronze
from plantpulse.sources.dimensions import calendar_labels, spine_by_bounds
from plantpulse.sources.shared import materialise
from plantpulse.warehouse import Warehouse


def _parsed_telemetry(wh: Warehouse, keep: tuple[str, ...]) -> DataFrame:
    return bronze.parse_telemetry(wh["raw_telemetry"], keep=keep)


def bronze_telemetry(wh: Warehouse, keep: tuple[str, ...] = ("source_timestamp",)) -> DataFrame:
    return bronze.accepted(_parsed_telemetry(wh, keep), "raw_payload")


def bronze_rejects(wh: Warehouse, keep: tuple[str, ...] = ("source_timestamp",)) -> DataFrame:
    """Telemetry messages that could not be used, and why."""
    return bronze.rejected(_parsed_telemetry(wh, keep), "raw_payload", keep)


def bronze_maintenance(wh: Warehouse) -> DataFrame:
    return bronze.accepted(bronze.parse_maintenance(wh["raw_maintenance"]), "log_data")


def maintenance_rejects(wh: Warehouse) -> DataFrame:
    return bronze.rejected(bronze.parse_maintenance(wh["raw_maintenance"]), "log_data")


def bronze_equipment(wh: Warehouse) -> DataFrame:
    return bronze.accepted(bronze.parse_equipment(wh["raw_equipment"]), "equipment_data")


def equipment_rejects(wh: Warehouse) -> DataFrame:
    return bronze.rejected(bronze.parse_equipment(wh["raw_equipment"]), "equipment_data")


def bronze_to_wide(wh: Warehouse, columns: dict[str, str]) -> DataFrame:
    """Accepted messages to one row per device and hour."""
    long = bronze_telemetry(wh).withColumn("hour_timestamp", hour_start("source_timestamp"))
    wide = bronze.wide_telemetry(long, "device_id", "hour_timestamp", "metric", "value", columns)
    return wide.select("device_id", "hour_timestamp", *[F.round(c, 4).alias(c) for c in columns.values()])


def silver_readings(wh: Warehouse, columns: dict[str, str]) -> DataFrame:
    """One row per asset and time with a column per metric; devices are known by the asset's natural key."""
    known = wh.current_assets().select(F.col("asset_nk").alias("device_id"), "asset_id")
    long = bronze_telemetry(wh).join(known, "device_id")
    return bronze.wide_telemetry(long, "asset_id", "source_timestamp", "metric", "value", columns).withColumnRenamed(
        "source_timestamp", "recorded_at")


def unknown_devices(wh: Warehouse) -> DataFrame:
    """Devices of accepted messages that no current asset answers to, with their number of messages."""
    counts = bronze_telemetry(wh).groupBy("device_id").agg(F.count(F.lit(1)).alias("messages"))
    return counts.join(wh.current_assets(), counts["device_id"] == F.col("asset_nk"), "left_anti")


def date_dimension(wh: Warehouse) -> DataFrame:
    """Calendar from the first to the last work order."""
    span = wh["fct_maintenance_log"].agg(F.min("completed_date").alias("a"), F.max("completed_date").alias("b"))
    return calendar_labels(span.select(F.explode(F.sequence("a", "b")).alias("full_date")))


def spine_gaps(wh: Warehouse) -> DataFrame:
    """Asset-days without a reading between an asset's first and last reading."""
    days = wh["fct_asset_telemetry"].select("asset_id", F.to_date("recorded_at").alias("day"))
    bounds = days.groupBy("asset_id").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    spine = spine_by_bounds(bounds, "a", "b", "1 DAY", "day").select("asset_id", "day")
    return quality.missing_slots(spine, days, ["asset_id", "day"])


def hour_gaps(wh: Warehouse) -> DataFrame:
    """How many hours between an asset's first and last have no reading.

    Only the number is asked for, so the hours present are counted and no grid is made.
    """
    hours = wh["fct_asset_telemetry"].select("asset_id", hour_start("recorded_at").alias("hour")).distinct()
    micros = wall_micros(F.col("hour"))
    counts = hours.groupBy("asset_id").agg(
        (F.floor((F.max(micros) - F.min(micros)) / 3_600_000_000) + 1 - F.count(F.lit(1))).alias("missing_hours"))
    return counts.filter(F.col("missing_hours") > 0)


def dq_keys(wh: Warehouse) -> DataFrame:
    """Parts rows sharing an (order, material) key."""
    return quality.duplicate_keys(wh["fct_maintenance_parts_used"], ["log_id", "material_id"])


def dq_orphans(wh: Warehouse) -> DataFrame:
    """Parts rows without their work order, and work orders without any parts row."""
    return quality.unmatched_both_ways(wh["fct_maintenance_parts_used"], wh["fct_maintenance_log"], "log_id",
                                       "parts to order", "order to parts")


def dq_ranges(wh: Warehouse) -> DataFrame:
    """Rows breaking the value ranges of telemetry and production."""
    t = quality.count_violations(wh["fct_asset_telemetry"], {
        "health within 0 and 100": F.col("health_score").between(0, 100),
        "probability within 0 and 1": F.col("failure_probability").between(0, 1),
        "health of 80 or more": F.col("health_score") >= 80,
        "life of a day or more": F.col("rul_days") >= 1})
    p = quality.count_violations(wh["fct_production_log"], {
        "runtime not negative": F.col("actual_runtime_hours") >= 0,
        "runtime within plan": F.col("actual_runtime_hours") <= F.col("planned_runtime_hours"),
        "scrap within output": F.col("units_scrapped") <= F.col("units_produced")})
    return t.unionByName(p)


def dq_failure_codes(wh: Warehouse) -> DataFrame:
    """A failure code stands exactly on the rows flagged as failures."""
    code, failed = F.col("failure_code_id").isNotNull(), F.col("failure_flag")
    return quality.count_violations(wh["fct_maintenance_log"], {
        "code only on failures": failed | ~code, "every failure has a code": ~failed | code,
        "known order type": F.col("wo_type_id").isin(1, 2, 3, 4)})


def _report(wh: Warehouse, done: list[DataFrame], left_out: list[str]) -> DataFrame:
    """The reports of all checks; one that could not be made is there by name, with null for rows and violations."""
    unchecked = wh.spark.createDataFrame([(name, None, None) for name in left_out], "check STRING, rows BIGINT, violations BIGINT")
    return reduce(DataFrame.unionByName, [*done, unchecked])


def _has(wh: Warehouse, name: str, *columns: str) -> bool:
    return name in wh and set(columns) <= set(wh[name].columns)


def dq_all_keys(wh: Warehouse) -> DataFrame:
    """For each table with a declared key: its rows, and how many share their key with another or lack a part of it (null: the table or its key is not there)."""
    keyed = {name: spec.key for name, spec in TABLES.items() if spec.key}
    there = [name for name, key in keyed.items() if _has(wh, name, *key)]
    return _report(wh, [quality.key_report(wh[name], keyed[name], name) for name in there], [n for n in keyed if n not in there])


def dq_all_references(wh: Warehouse) -> DataFrame:
    """For each relationship: rows that refer, and those whose parent is missing (null: a table or column of it is not there)."""
    edges = {f"{r.child}.{r.child_key}": r for r in RELATIONSHIPS}
    there = [name for name, r in edges.items() if _has(wh, r.child, r.child_key) and _has(wh, r.parent, r.parent_key)]
    return _report(wh, [quality.reference_report(wh[r.child], r.child_key, wh[r.parent], r.parent_key, name)
                        for name, r in edges.items() if name in there], [n for n in edges if n not in there])


def dq_parts_cost(wh: Warehouse) -> DataFrame:
    """Parts rows whose cost is not quantity x unit cost, per supplier."""
    unit = wh["dim_material"].select("material_id", "supplier_name", "unit_cost")
    per_material = wh["fct_maintenance_parts_used"].join(unit, "material_id")
    wrong = F.col("total_cost") != F.col("quantity_used") * F.col("unit_cost")
    return per_material.groupBy("supplier_name").agg(
        F.count(F.lit(1)).alias("parts_rows"), F.count_if(wrong).alias("mismatched_rows"))


CHANGES = ("model", "oem_name")


def equipment_changes(wh: Warehouse) -> DataFrame:
    return bronze.accepted(bronze.parse_equipment_changes(wh["raw_equipment_feed"]), "equipment_data")


def asset_versions_built(wh: Warehouse) -> DataFrame:
    """All versions of the assets' model and maker, from every equipment message."""
    return versions_of(equipment_changes(wh), "serial_number", "effective_at", "ingestion_timestamp", CHANGES)


def asset_versions_merged(wh: Warehouse, cut: dt.datetime | str) -> DataFrame:
    """The same in two loads: what had arrived before ``cut``, then the messages after it, corrections of the past among them."""
    messages = equipment_changes(wh)
    late = messages.filter(F.col("ingestion_timestamp") >= as_ntz(cut))
    early = materialise(versions_of(messages.filter(F.col("ingestion_timestamp") < as_ntz(cut)), "serial_number", "effective_at",
                                    "ingestion_timestamp", CHANGES), "versions")
    return merge_versions(early, messages, late, "serial_number", "effective_at", "ingestion_timestamp", CHANGES)


def _documents(wh: Warehouse) -> DataFrame:
    return bronze.parse_variant(wh["raw_telemetry"], "raw_payload").filter(F.col("document").isNotNull())


def variant_fields(wh: Warehouse) -> DataFrame:
    """Fields of the telemetry messages as they are, damaged values included."""
    return bronze.variant_fields(_documents(wh))


def variant_values(wh: Warehouse) -> DataFrame:
    """Values by path from the documents: null where a value is missing or of another type."""
    path = lambda p, kind: F.try_variant_get("document", f"$.{p}", kind)
    return _documents(wh).select("event_id", path("deviceId", "string").alias("device_id"), path("value", "double").alias("value"),
                                 path("metric", "string").alias("metric"))
