"""Tables kept up to date by loads, versions from messages, drill-across, binned range joins, sketches, late and silent feeds."""

from __future__ import annotations

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from plantpulse.operators.intervals import trailing_join
from plantpulse.operators.joins import FactPart, drill_across
from plantpulse.operators.latest import latest_per_key, order_key
from plantpulse.operators.versions import broken_intervals, merge_versions, versions_of
from plantpulse.plans import assets, gold, health, questions
from plantpulse.sources.tables import BUCKETS, append_table, merge_latest, read_table
from plantpulse.streaming import telemetry as streams
from plantpulse.warehouse import Warehouse

TELEMETRY = "fct_asset_telemetry"
T0 = dt.datetime(2024, 1, 1)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_order_key_orders_like_the_pair(spark):
    times = [dt.datetime(1, 1, 1), dt.datetime(1969, 12, 31, 23, 59, 59, 999999), T0, T0 + dt.timedelta(microseconds=1), dt.datetime(9999, 12, 31)]
    ids = [-2 ** 63, -1, 0, 1, 2 ** 63 - 1]
    rows = spark.createDataFrame([(t, i) for t in times for i in ids] + [(None, 1)], "t timestamp_ntz, i long")
    got = rows.select("t", "i", order_key(F.col("t"), F.col("i")).alias("k")).collect()
    known = [r for r in got if r.t is not None]
    assert [(r.t, r.i) for r in sorted(known, key=lambda r: r.k)] == sorted((r.t, r.i) for r in known)
    assert len({r.k for r in known}) == len(known) and [r.k for r in got if r.t is None] == [None]


def test_ties_go_to_the_greatest_id(spark):
    rows = spark.createDataFrame([(1, T0, 5, 1.0), (1, T0, 7, None), (1, T0, -3, 3.0), (2, None, 1, 4.0)], "k int, t timestamp_ntz, id long, v double")
    got = {r.k: (r.t, r.v) for r in latest_per_key(rows, ["k"], "t", ["v"], ["id"]).collect()}
    assert got[1] == (T0, None) and got[2][0] is None


def test_latest_rows_do_not_sort(sample):
    for plan in (assets.sensor_status, assets.latest_telemetry, assets.latest_prediction, assets.latest_state, questions.flagged_assets):
        assert "SortAggregate" not in plan_of(plan(sample)), plan


def test_merge_rewrites_touched_buckets_only(spark, tmp_path):
    root, name = str(tmp_path), "agg_asset_latest_health"
    kind = "asset_id long, hour_timestamp timestamp_ntz, latest_health_score decimal(5,2), avg_failure_probability decimal(3,2), min_rul_days int"

    def merge(rows):
        merge_latest(spark.createDataFrame(rows, kind), root, name, "hour_timestamp")
        table = read_table(spark, root, name)
        return {r.asset_id: (r.hour_timestamp, r.min_rul_days) for r in table.collect()}, {str(p) for p in tmp_path.rglob("*.parquet")}

    hour = dt.timedelta(hours=1)
    first, files = merge([(i, T0 + hour * (i % 3), None, None, i) for i in range(500)])
    assert len(first) == 500
    got, after = merge([(7, T0 + hour * 9, None, None, 70), (7, T0 + hour * 8, None, None, 71), (8, T0 - hour, None, None, 80), (9, first[9][0], None, None, 90), (1000, T0, None, None, 1)])
    assert got == first | {7: (T0 + hour * 9, 70), 9: (first[9][0], 90), 1000: (T0, 1)}
    assert len(files - after) <= 4 < BUCKETS and len({p.split("bucket=")[1].split("/")[0] for p in files}) > 40
    assert merge([(7, T0 + hour * 9, None, None, 70)])[0] == got


def test_a_day_needs_eight_days_of_readings(spark, sample, tmp_path):
    """With the state before it, day 21 is the same although only days 14 to 21 can be read."""
    root = str(tmp_path)
    gold.load_feature_store(sample, root, "2024-01-01", "2024-01-20")
    tail = sample[TELEMETRY].filter(F.to_date("recorded_at").between("2024-01-14", "2024-01-21"))
    service = sample["fct_service_log"].filter(F.col("completed_date").between("2024-01-14", "2024-01-28"))
    gold.load_feature_store(sample.with_tables(fct_asset_telemetry=tail, fct_service_log=service), root, "2024-01-21", "2024-01-21")
    one = read_table(spark, root, "ml_feature_store").filter("observation_date_sk = 20240121")
    full = gold.feature_store(sample).filter("observation_date_sk = 20240121")
    both = [sorted(tuple(str(x) for x in r) for r in df.select("asset_id", "avg_temp_last_24h", "cycles_since_last_pm", "days_since_last_failure", "oem_failure_rate_est",
                                                               "vibration_stddev_7d", "pressure_trend_7d", "failed_in_next_7_days").collect()) for df in (one, full)]
    assert both[0] == both[1] and both[0]


def test_pages_read_the_kept_rows(spark, sample, tmp_path):
    root = str(tmp_path)
    for name in ("dim_asset", "dim_asset_class", "dim_process", "dim_line", "dim_plant", TELEMETRY):
        append_table(sample[name].coalesce(1), root, name)
    append_table(sample["agg_asset_hourly_health"].withColumn("hour_date", F.to_date("hour_timestamp")).coalesce(1), root, "agg_asset_hourly_health")
    wh = Warehouse.open(spark, root)
    want = sorted(map(tuple, health.latest_health_report(wh).collect()))  # derived: nothing was loaded yet
    gold.load_latest_health(wh, root, "2024-01-01", "2024-01-15")
    gold.load_latest_health(wh, root, "2024-01-16", "2024-01-31")
    kept = Warehouse.open(spark, root)
    assert sorted(map(tuple, health.latest_health_report(kept).collect())) == want
    for plan in (health.latest_health_report, questions.weak_assets, questions.result_top10, lambda w: health.asset_details(w, 7)):
        text = " ".join(plan(kept).inputFiles())
        assert "agg_asset_latest_health" in text and "agg_asset_hourly_health" not in text and TELEMETRY not in text


def brute_versions(messages):
    out = []
    for key in {m[0] for m in messages}:
        by_time = {}
        for _, at, came, value in sorted((m for m in messages if m[0] == key), key=lambda m: (m[1], m[2], m[3])):
            by_time[at] = value
        starts = []
        for at in sorted(by_time):
            if not starts or starts[-1][1] != by_time[at]:
                starts.append((at, by_time[at]))
        out += [(key, v, at, starts[i + 1][0] if i + 1 < len(starts) else None) for i, (at, v) in enumerate(starts)]
    return sorted(out, key=repr)


def test_versions(spark):
    rng = random.Random(2)
    messages = [(f"k{min(rng.randrange(12), 5)}", T0 + dt.timedelta(days=rng.randrange(200)), T0 + dt.timedelta(days=rng.randrange(400)), rng.choice("abc")) for _ in range(400)]
    kind = "k string, at timestamp_ntz, came timestamp_ntz, v string"
    df = spark.createDataFrame(messages, kind).repartition(4)
    args = ("k", "at", "came", ["v"])

    def rows(versions):
        return sorted(((r.k, r.v, r.scd_start_date, r.scd_end_date) for r in versions.collect()), key=repr)

    built = versions_of(df, *args)
    assert rows(built) == brute_versions(messages)
    assert broken_intervals(built, "k").count() == 0
    cut = T0 + dt.timedelta(days=250)
    early, late = df.filter(F.col("came") < cut), df.filter((F.col("came") >= cut) & (F.col("k") != "k5"))
    known = early.unionByName(late)
    merged = merge_versions(versions_of(early, *args), known, late, *args)
    assert rows(merged) == brute_versions([m for m in messages if m[2] < cut or m[0] != "k5"])
    overlapping = built.unionByName(built.limit(1))
    assert broken_intervals(overlapping, "k").count() == 1
    assert versions_of(df.limit(0), *args).collect() == []


def test_versions_neither_sort_what_a_task_read_nor_broadcast(spark):
    """Small files, so that Spark would broadcast; a third of the messages are for one time of one entity."""
    rng = random.Random(3)
    day = dt.timedelta(days=1)
    messages = [(f"k{i % 3}", T0 + day * (7 if i % 3 == 0 else rng.randrange(200)), T0 + day * rng.randrange(9), rng.choice("abc")) for i in range(300)]
    messages += messages[:30]
    df = spark.createDataFrame([*messages, (None, T0, T0, "a"), ("k1", None, T0, "a")], "k string, at timestamp_ntz, came timestamp_ntz, v string").repartition(4)
    args = ("k", "at", "came", ["v"])
    built = versions_of(df, *args)
    merged = merge_versions(versions_of(df.filter(F.col("came") < T0 + 5 * day), *args), df, df.filter(F.col("came") >= T0 + 5 * day), *args)
    for versions in (built, merged):
        plan = plan_of(versions)
        assert "Broadcast" not in plan
        assert "SortAggregate" not in plan[plan.rindex("REBALANCE_PARTITIONS_BY_COL"):]
        assert sorted(((r.k, r.v, r.scd_start_date, r.scd_end_date) for r in versions.collect()), key=repr) == brute_versions(messages)


def test_drill_across_refuses_fan_out(sample):
    part = FactPart("fct_maintenance_log", ("asset_id",), F.trunc("completed_date", "month"), {"orders": F.count(F.lit(1))})
    rows = drill_across(sample, [part], {"dim_line": ["line_name"]}).collect()
    assert sum(r.orders for r in rows) == sample["fct_maintenance_log"].count()
    twice = sample.with_tables(dim_line=sample["dim_line"].union(sample["dim_line"].limit(1)))
    with pytest.raises(ValueError, match="dim_line has 2 rows"):
        drill_across(twice, [part], {"dim_line": ["line_name"]})


def test_trailing_join_bounds(spark):
    hour = dt.timedelta(hours=1)
    points = spark.createDataFrame([(1, T0), (1, T0 + 5 * hour), (2, T0), (3, T0)], "k int, t timestamp_ntz")
    seen = [T0 - 3 * hour, T0 - 3 * hour - dt.timedelta(microseconds=1), T0 - dt.timedelta(microseconds=1), T0, T0 + 2 * hour]
    readings = spark.createDataFrame([(k, s) for k in (1, 2) for s in seen] + [(None, T0)], "k int, s timestamp_ntz")
    joined = trailing_join(points, readings, "k", "t", "s", 3)
    assert sorted((r.k, r.t, r.s) for r in joined.collect()) == sorted(
        (k, t, s) for k, t in [(1, T0), (1, T0 + 5 * hour), (2, T0)] for s in seen if t - 3 * hour <= s < t)
    assert "NestedLoop" not in plan_of(joined) and "Cartesian" not in plan_of(joined)


def test_sketches_answer_without_readings(spark, sample, tmp_path):
    assets.sensor_sketches(sample).write.parquet(f"{tmp_path}/sketches")
    stored = spark.read.parquet(f"{tmp_path}/sketches")
    days = assets.assets_read_between(stored, "2024-01-03", "2024-01-20")
    assert days.inputFiles() and all("/sketches/" in f for f in days.inputFiles())
    assert {r.sensor_type for r in days.collect()} == {"Temperature", "Vibration", "Pressure"}


def test_one_sketch_for_all_hot_sensors(spark):
    """Not one for each sensor; sensors and readings repeat or lack their number, and no table is broadcast."""
    readings = [(i, i % 40, T0, 60.0 + i % 40) for i in range(200)] + [(200, None, T0, 90.0), (201, 5, T0 - dt.timedelta(days=9), 90.0), (202, 39, T0, None)]
    columns = "telemetry_id long, asset_id long, recorded_at timestamp_ntz, temperature_c double"
    telemetry = spark.createDataFrame(readings, columns).selectExpr("*", "cast(NULL AS double) AS vibration_mm_s", "cast(NULL AS double) AS pressure_psi")
    sensors = [(a * 3 if a != 30 else None, a, "Temperature") for a in [*range(39), 20]] + [(a * 3 + 1, a, "Pressure") for a in range(39)]
    wh = Warehouse(spark, {TELEMETRY: telemetry, "dim_sensor": spark.createDataFrame(sensors, "sensor_sk long, asset_id long, sensor_type string")})
    compared = assets.hot_sensors_compared(wh, T0)
    plan = plan_of(compared)
    assert "approx_count_distinct" in plan and not re.search(r"keys=\[[^\]\n]+\][^\n]*approx_count_distinct", plan)
    assert "Broadcast" not in plan
    assert [tuple(r) for r in compared.collect()] == [(27, True)] and [tuple(r) for r in assets.hot_sensors(wh, T0).collect()] == [(27,)]
    assert [tuple(r) for r in assets.hot_sensors_compared(wh, T0, above=500).collect()] == [(0, True)]


def _feed(spark, folder, batches):
    kind = "telemetry_id long, asset_id long, recorded_at timestamp_ntz"
    for rows in batches:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(folder)
    return streams.read_feed(spark, folder, kind, files_per_batch=1)


def test_late_rows_are_kept(spark, tmp_path):
    hour = dt.timedelta(hours=1)
    batches = [[(1, 1, T0 + 10 * hour), (2, 1, T0)], [(3, 1, T0 + 7 * hour), (4, 1, T0 + 8 * hour), (5, 2, T0 + 30 * hour)], [(6, 1, T0 + 27 * hour), (7, 1, None)]]
    figures, late = streams.late_rows_kept(_feed(spark, f"{tmp_path}/in", batches), 2, f"{tmp_path}/out")
    assert {(r.telemetry_id, r.batch_id) for r in late.collect()} == {(3, 1), (6, 2)}
    assert [(r.rows_seen, r.late_rows) for r in figures.orderBy("batch_id").collect()] == [(2, 0), (3, 1), (2, 1)]


def test_silent_assets_over_batches(spark, tmp_path):
    day = dt.timedelta(days=1)
    batches = [[(1, 1, T0), (2, 2, T0)], [(3, 1, T0 + day), (4, 3, T0 + 3 * day)], [(5, 1, T0 + 4 * day)], [(6, 3, T0 + 6 * day)]]
    out = streams.silent_assets(_feed(spark, f"{tmp_path}/in", batches), 48, folder=f"{tmp_path}/out").collect()
    assert sorted((r.asset_id, r.silent_since) for r in out) == [(1, T0 + day), (2, T0), (3, T0 + 3 * day)]
    assert all(r.told_at == r.silent_since + 2 * day for r in out)
