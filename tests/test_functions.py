"""Column functions on hand-made values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plantpulse.functions import bands, dates, numeric, text


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_half_up_rounds_away_from_zero(spark):
    got = values(spark, [(2.5,), (-2.5,), (0.125,), (None,)], "v double", numeric.half_up(F.col("v"), 2))
    assert got == [2.5, -2.5, 0.13, None]
    assert values(spark, [(2.5,), (-2.5,)], "v double", numeric.half_up(F.col("v"), 0)) == [3.0, -3.0]


def test_half_up_of_large_values(spark):
    rows = [(1e13 + 0.123456,), (3e13,), (1e17,), (-3e300,), (float("inf"),)]
    for digits in (2, 4, 6):
        got = values(spark, rows, "v double", numeric.half_up(F.col("v"), digits))
        assert all(g == v or abs(g - v) <= 0.5 * 10 ** -digits + 1e-2 for g, (v,) in zip(got, rows))


def test_ratio_guards_zero_and_null(spark):
    rows = [(1.0, 2.0), (1.0, 0.0), (None, 2.0), (1.0, None)]
    assert values(spark, rows, "n double, d double", numeric.ratio(F.col("n"), F.col("d"))) == [0.5, 0.0, None, 0.0]
    assert values(spark, rows, "n double, d double", numeric.ratio_or_null(F.col("n"), F.col("d"))) == [0.5, None, None, None]


def test_clamp_keeps_null(spark):
    assert values(spark, [(5.0,), (None,), (200.0,)], "v double", numeric.clamp(F.col("v"), 10.0, 100.0)) == [10.0, None, 100.0]


@pytest.mark.parametrize("planned, actual, made, lost, expected", [
    (10.0, 5.0, 100, 10, 0.5 * 0.95 * 0.9), (0.0, 0.0, 100, 10, 0.0), (10.0, 5.0, 0, 0, 0.0), (0.0, 0.0, 0, 0, 0.0)])
def test_oee_zero_branches(spark, planned, actual, made, lost, expected):
    df = spark.createDataFrame([(planned, actual, made, lost)], "p double, a double, u bigint, s bigint")
    got = df.select(bands.oee(F.col("p"), F.col("a"), F.col("u"), F.col("s"))).first()[0]
    assert got == pytest.approx(expected)


@pytest.mark.parametrize("kind, value, band", [
    ("Temperature", 100.0, "normal"), ("Temperature", 100.01, "warning"), ("Temperature", 150.0, "warning"),
    ("Temperature", 150.01, "critical"), ("Vibration", 1.5, "normal"), ("Vibration", 2.0, "warning"),
    ("Vibration", 2.01, "critical"), ("Pressure", 120.0, "normal"), ("Pressure", 160.0, "normal"),
    ("Pressure", 119.9, "warning"), ("Pressure", 160.1, "warning"), ("Torque", 999.0, "normal"), ("Pressure", None, None)])
def test_sensor_bands_are_strict(spark, kind, value, band):
    df = spark.createDataFrame([(kind, value)], "k string, v double")
    assert df.select(bands.sensor_status(F.col("k"), F.col("v"))).first()[0] == band


def test_health_bands_are_inclusive(spark):
    scores = [(90.0,), (89.9,), (75.0,), (74.9,), (70.0,), (69.9,), (None,)]
    assert values(spark, scores, "v double", bands.health_band(F.col("v"))) == [
        "excellent", "attention", "attention", "immediate", "immediate", "immediate", None]
    assert values(spark, scores, "v double", bands.tool_health_status(F.col("v"))) == [
        "healthy", "warning", "warning", "warning", "warning", "critical", None]


def test_asset_status_and_defaults(spark):
    rows = [(0.9, True), (0.49, False), (0.5, False), (0.7, False), (None, None)]
    assert values(spark, rows, "h double, a boolean", bands.asset_status(F.col("h"), F.col("a"))) == [
        "Critical", "Critical", "Warning", "Online", "Online"]


def test_rule_formulas(spark):
    df = spark.createDataFrame([(0, 0, 0.0), (100, 10, 5.0), (400, 23, 5.0)], "d int, h int, l double")
    health = bands.rule_health_score(F.col("d"), F.col("h"), F.col("l"))
    got = [tuple(r) for r in df.select(health, bands.rule_failure_probability(health), bands.rule_rul_days(F.col("d"))).collect()]
    assert got == [(100.0, 0.01, 400), (79.0, 0.05, 320), (70.0, 0.08, 80)]
    assert values(spark, [(2000,)], "d int", bands.rule_rul_days(F.col("d"))) == [1]


def test_anomaly_rule(spark):
    rows = [(79.9, 0.1, False), (80.0, 1.3, False), (80.0, 1.3, True), (80.0, 1.2, True), (None, None, None)]
    got = values(spark, rows, "h double, v double, r boolean", bands.is_anomaly(F.col("h"), F.col("v"), F.col("r")))
    assert got == [True, False, True, False, False]


def test_roi_and_risk(spark):
    assert values(spark, [(50000.0, 150000.0), (0.0, 1.0)], "c double, a double", bands.roi(F.col("c"), F.col("a"))) == [2.0, 0.0]
    risk = bands.production_at_risk(F.lit("0.25"), F.lit("1000.50"))
    assert float(spark.range(1).select(risk).first()[0]) == 6003.0


def test_response_type_order(spark):
    rows = [("Request FAILED, work order created",), ("Work Order ready",), ("Query Results (3 rows)",), ("\U0001F4CA chart",),
            ("hello",), (None,)]
    df = text.with_response_type(spark.createDataFrame(rows, "t string"), "t")
    assert df.columns == ["t", "response_type"]
    assert [r.response_type for r in df.collect()] == ["error", "action", "data", "data", "assistant", "assistant"]


def test_paths(spark):
    path = F.lit("site/north/line_a/press/pump_1/vibration")
    row = spark.range(1).select(text.path_level(path, 0), text.path_level(path, 4), text.path_level(path, 9),
                                text.under_path(path, "site/north"), text.under_path(path, "site/nor"), text.path_depth(path)).first()
    assert tuple(row) == ("site", "pump_1", None, True, False, 6)


def test_hour_start_ignores_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.sql("SELECT TIMESTAMP_NTZ'2025-03-09 02:30:15' AS t")  # an hour that does not exist in that zone
        assert str(df.select(dates.hour_start("t")).first()[0]) == "2025-03-09 02:00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_date_key_and_texts(spark):
    row = spark.range(1).select(dates.date_sk(F.lit("2025-03-09").cast("date")), text.percent_text(F.lit(0.0512)),
                                text.hourly_cost_text(F.lit(7500.4)), dates.quarter_label(F.lit("2025-03-09").cast("date"))).first()
    assert tuple(row) == (20250309, "5.1%", "$7,500/hr", "2025-Q1")
