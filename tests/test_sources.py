"""Parsing, dimensions, table layout, conversation store."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plantpulse.sources import bronze, dimensions, tables
from plantpulse.warehouse import Warehouse

# Invented messages; the faults are one of each kind.
TELEMETRY = [
    ('{"deviceId": "kiln-7/flow", "metric": "flow", "value": 12.25, "unit": "l/s"}', "2031-04-02 03:15:00"),
    ('{"deviceId": "kiln-7/heat", "metric": "heat", "value": 871, "unit": "K"}', "2031-04-02 03:15:00"),
    ('{"deviceId": "kiln-7/flow", "metric": "flow", "value": 3.5, "unit": "l/s"}', "2031-05-11 17:40:00"),
    ('{"deviceId": "kiln-7/flow", "metric": "flow", "val', "2031-05-11 17:41:00"),
    ('{"deviceId": "kiln-7/flow", "metric": "flow", "value": "low"}', "2031-05-11 17:42:00"),
    ('{"metric": "flow", "value": 9.75}', "2031-05-11 17:43:00"),
    (None, "2031-05-11 17:44:00"),
]


@pytest.fixture
def raw(spark):
    return spark.createDataFrame(TELEMETRY, "raw_payload string, ts string").withColumn(
        "source_timestamp", F.col("ts").cast("timestamp_ntz"))


def test_telemetry_accepts_and_rejects(raw):
    parsed = bronze.parse_telemetry(raw)
    good = bronze.accepted(parsed, "raw_payload").orderBy("source_timestamp", "device_id").collect()
    assert [(r.device_id, r.metric, r.value, r.unit) for r in good] == [
        ("kiln-7/flow", "flow", 12.25, "l/s"), ("kiln-7/heat", "heat", 871.0, "K"), ("kiln-7/flow", "flow", 3.5, "l/s")]
    bad = bronze.rejected(parsed, "raw_payload", ("source_timestamp",)).orderBy("source_timestamp").collect()
    assert [r.reject_reason for r in bad] == ["not json", "wrong type value", "missing deviceId", "not json"]
    assert bad[0].raw_payload == TELEMETRY[3][0]


def test_maintenance_and_equipment(spark):
    order = ('{"workOrderId": "K-31", "assetId": "kiln-7", "type": "ZZ", "notes": "relined", "downtimeHours": 11.5, "laborCost": 90, '
             '"partsCost": 17.3, "failure": false, "date": "2031-06-30"}')
    got = bronze.accepted(bronze.parse_maintenance(spark.createDataFrame([(order,)], "log_data string")), "log_data").first()
    assert got.downtime_hours == 11.5 and got.failure_flag is False and got.completed_date == dt.date(2031, 6, 30)
    machine = '{"serialNumber": "kiln-7", "model": "M", "oem": "O", "installDate": "2019-12-08", "assetType": "P", "plant": "N"}'
    raw = spark.createDataFrame([(machine,), ('{"serialNumber": "x", "installDate": "soon"}',)], "equipment_data string")
    parsed = bronze.parse_equipment(raw)
    assert bronze.accepted(parsed, "equipment_data").first().installation_date == dt.date(2019, 12, 8)
    assert bronze.rejected(parsed, "equipment_data").first().reject_reason == "wrong type installDate"


def test_variant_and_ingestion_stamp(raw):
    doc = bronze.parse_variant(raw, "raw_payload").select(F.try_variant_get("document", "$.value", "double").alias("v"))
    assert [r.v for r in doc.collect()][:3] == [12.25, 871.0, 3.5]
    assert bronze.stamp_ingestion(raw).filter("ingestion_timestamp IS NULL").count() == 0


def test_wide_form(raw):
    good = bronze.accepted(bronze.parse_telemetry(raw), "raw_payload").withColumn("entity", F.lit("kiln-7"))
    wide = bronze.wide_telemetry(good, "entity", "source_timestamp", "metric", "value", {"heat": "t", "flow": "v"})
    assert [(r.t, r.v) for r in wide.orderBy("source_timestamp").collect()] == [(871.0, 12.25), (None, 3.5)]


def test_calendar(spark):
    cal = dimensions.date_dimension(spark, "1995-01-01", "2030-12-31")
    assert cal.count() == 13149
    first = cal.orderBy("date_sk").first()
    assert tuple(first) == (19950101, dt.date(1995, 1, 1), "Sunday", "January", 1, 1995)


def test_spine_includes_the_end(spark):
    spine = dimensions.time_spine(spark.range(2).withColumnRenamed("id", "asset_id"), "2025-01-01 00:00:00", "2025-01-01 05:00:00", "1 HOUR")
    assert spine.count() == 12 and str(spine.agg(F.max("spine_ts")).first()[0]) == "2025-01-01 05:00:00"


def test_repeat_rows(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 3)], "k int, n int")
    assert sorted(tuple(r)[::2] for r in dimensions.repeat_rows(df, "n", "i").collect()) == [(2, 1), (3, 1), (3, 2), (3, 3)]


def test_code_tables(spark):
    assert dimensions.work_order_types(spark).count() == 4 and dimensions.failure_codes(spark).count() == 12


def test_append_overwrite_and_layout(spark, tmp_path):
    rows = [(i, i % 3, dt.date(2025, 1, 1 + i % 2), 20250101 + i % 2) for i in range(20)]
    df = spark.createDataFrame(rows, "prod_log_id bigint, asset_id bigint, production_date date, date_sk int")
    root, name = str(tmp_path), "fct_production_log"
    tables.append_table(df.filter("prod_log_id < 10"), root, name)
    tables.append_table(df.filter("prod_log_id >= 10"), root, name)
    wh = Warehouse.open(spark, root)
    assert wh[name].count() == 20
    assert wh[name].schema["planned_runtime_hours"].dataType.simpleString() == "decimal(4,1)"
    tables.overwrite_table(df.filter("date_sk = 20250102").limit(3), root, name)
    left = {r.date_sk: r["count"] for r in tables.read_table(spark, root, name).groupBy("date_sk").count().collect()}
    assert left == {20250101: 10, 20250102: 3}
    plan = wh.last_days(name, "2025-01-02", 0)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date_sk" in plan


def test_text_preview(spark, tmp_path):
    path = tmp_path / "a.txt"
    path.write_text("\n".join(f"line {i}" for i in range(9)))
    assert [r.value for r in tables.preview_text(spark, str(path)).collect()] == [f"line {i}" for i in range(5)]


def test_conversation_store(spark, tmp_path):
    rows = [("c1", f"m{i}", "u", dt.datetime(2025, 1, 1, 0, i), "user", f"q{i}") for i in range(4)] + [
        ("c2", "x", "u", dt.datetime(2025, 1, 1), "user", "other")]
    df = spark.createDataFrame(rows, "conversation_id string, message_id string, user_id string, timestamp timestamp_ntz, role string, content string")
    tables.save_messages(df, str(tmp_path))
    assert [r.content for r in tables.load_conversation(spark, str(tmp_path), "c1").collect()] == ["q0", "q1", "q2", "q3"]
    assert [r.content for r in tables.load_conversation(spark, str(tmp_path), "c1", last=2).collect()] == ["q2", "q3"]
