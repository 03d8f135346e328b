"""Operators on hand-made frames and against plain brute force."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from plantpulse.functions.python_functions import health_band_udf, oee_by_group, steps_udtf
from plantpulse.operators import joins, latest, ordered, quality, shape, shares, trailing
from plantpulse.plans import gold
from plantpulse.plans import maintenance as mnt
from plantpulse.plans import production as prod
from plantpulse.sources.dimensions import work_order_types
from plantpulse.warehouse import Warehouse

TELEMETRY = ("telemetry_id bigint, asset_id bigint, recorded_at timestamp_ntz, temperature_c decimal(6,2), vibration_mm_s decimal(8,4), "
             "pressure_psi decimal(6,2), health_score decimal(5,2), failure_probability decimal(3,2), rul_days int")
SERVICE = "asset_id bigint, completed_date date, wo_type_id int, failure_flag boolean"


def t(day: int, hour: int = 0) -> dt.datetime:
    return dt.datetime(2025, 1, 1) + dt.timedelta(days=day, hours=hour)


def d(day: int) -> dt.date:
    return t(day).date()


def readings(spark, rows):
    from decimal import Decimal as D

    data = [(i, a, ts, *(None if v is None else D(str(v)) for v in (temp, vib, psi)), D("90"), D("0.10"), 100)
            for i, (a, ts, temp, vib, psi) in enumerate(rows)]
    return spark.createDataFrame(data, TELEMETRY)


def keyed(df, *values):
    return {(r.observation_date_sk, r.asset_id): tuple(r[v] for v in values) for r in df.collect()}


def test_latest_takes_tie_break(spark):
    df = spark.createDataFrame([(1, 5, 10, "a"), (1, 5, 11, "b"), (1, 4, 99, "c"), (2, 1, 1, None)], "k int, ts int, id int, v string")
    got = sorted(tuple(r) for r in latest.latest_per_key(df, ["k"], "ts", ["v"], ["id"]).collect())
    assert got == [(1, 5, "b"), (2, 1, None)]
    plain = latest.latest_per_key(df.filter("id <> 11"), ["k"], "ts", ["id"])
    assert sorted(tuple(r) for r in plain.collect()) == [(1, 5, 10), (2, 1, 1)]


def test_latest_shuffles_one_row_per_key_and_task(spark):
    df = spark.range(100_000, numPartitions=8).select((F.col("id") % 3 == 0).cast("int").alias("k"), F.col("id").alias("ts"))
    plan = latest.latest_per_key(df, ["k"], "ts", ["ts"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("HashAggregate") == 2 and "SortAggregate" not in plan


def test_arg_max_prefers_smaller_id_on_ties(spark):
    df = spark.createDataFrame([("x", 5, 2), ("x", 5, 1), ("x", 4, 0)], "c string, m int, id int")
    assert tuple(latest.arg_max(df, ["c"], "m", "id", []).first()) == ("x", 5, 1)


def test_head_with_rest(spark):
    rows = latest.head_with_rest(spark.range(13), [F.col("id")], 10).collect()
    assert [r.id for r in rows] == list(range(10)) and {r.rows_not_shown for r in rows} == {3}
    assert {r.rows_not_shown for r in latest.head_with_rest(spark.range(4), [F.col("id")], 10).collect()} == {0}


@pytest.mark.parametrize("days, expected", [(7, (7.0, 7.0)), (8, (7.0, 3.0))])
def test_prior_week_needs_eight_days(spark, days, expected):
    df = spark.createDataFrame([(d(i), float(i)) for i in range(days - 1)] + [(d(days - 1), 7.0)], "day date, v double")
    row = shares.against_prior_mean(df, "day", "v").first()
    assert (row.current, row.prior_mean) == expected and row.observations == days


def test_shares_and_growth(spark):
    df = spark.createDataFrame([("a", 2024, 100.0), ("b", 2024, 300.0)], "p string, y int, v double")
    assert {r.p: r.s for r in shares.with_share(df, "v", "s").collect()} == {"a": 0.25, "b": 0.75}
    gap = spark.createDataFrame([("a", 2021, 100.0), ("a", 2023, 150.0)], "p string, y int, v double")
    assert {r.y: r.before for r in shares.with_previous(gap, "v", "y", "before", F.col("y") - 1, ["p"]).collect()} == {2021: None, 2023: None}
    years = spark.createDataFrame([("a", 2023, 100.0), ("a", 2024, 150.0), ("b", 2023, 0.0), ("b", 2024, 5.0)], "p string, y int, v double")
    got = shares.with_previous(years, "v", "y", "before", F.col("y") - 1, ["p"]).select("p", "y", shares.growth(F.col("v"), F.col("before")).alias("g"))
    assert {(r.p, r.y): r.g for r in got.collect()} == {("a", 2023): None, ("a", 2024): 0.5, ("b", 2023): None, ("b", 2024): None}


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_pieces_match_plain_windows(spark, size):
    rng = random.Random(5)
    rows = [(k, n, rng.choice("ua")) for k in range(4) for n in sorted(rng.sample(range(60), 5 if k else 40))]
    df = spark.createDataFrame(rows, "k int, n int, v string")
    piece = F.floor(F.col("n") / size)
    lead = {(r.k, r.n): r.nx for r in ordered.lead_in_pieces(df, ["k"], ["n"], piece, "v", "nx").collect()}
    number = {(r.k, r.n): r.no for r in ordered.number_in_pieces(df, ["k"], ["n"], piece, "no").collect()}
    groups = defaultdict(list)
    for k, n, v in rows:
        groups[k].append((n, v))
    for k, items in groups.items():
        for i, (n, _) in enumerate(items):
            assert lead[k, n] == (items[i + 1][1] if i + 1 < len(items) else None)
            assert number[k, n] == i + 1


def test_sessions_match_brute_force(spark):
    rng = random.Random(9)
    rows = [(k, t(0) + dt.timedelta(minutes=rng.randrange(6000))) for k in range(3) for _ in range(80)]
    rows += [(9, t(0)), (9, t(0) + dt.timedelta(minutes=30)), (9, t(0) + dt.timedelta(minutes=60, seconds=1))]
    got = sorted((r.k, r.session_start, r.last_reading, r.readings) for r in ordered.sessions(
        spark.createDataFrame(rows, "k int, ts timestamp_ntz"), ["k"], "ts", 30).collect())
    want, groups = [], defaultdict(list)
    for k, ts in rows:
        groups[k].append(ts)
    for k, stamps in groups.items():
        stamps.sort()
        run = [stamps[0]]
        for ts in stamps[1:]:
            if ts - run[-1] > dt.timedelta(minutes=30):
                want.append((k, run[0], run[-1], len(run)))
                run = []
            run.append(ts)
        want.append((k, run[0], run[-1], len(run)))
    assert got == sorted(want)


def test_trailing_window_edges(spark):
    rows = [(1, t(0), 10, 1, None), (1, t(6, 23), 30, 2, None), (1, t(7), 50, 4, None), (1, t(8), 90, 8, None)]
    tel = readings(spark, rows)
    temp = keyed(gold.feature_temp_24h(tel), "avg_temp_last_24h")
    assert temp[20250108, 1] == (40.0,) and temp[20250109, 1] == (70.0,)  # the day before and the day, not the next
    vib = keyed(gold.feature_vibration_7d(tel), "vibration_stddev_7d")
    assert vib[20250101, 1] == (None,)
    assert vib[20250108, 1] == (1.53,)  # 1, 2, 4: the reading at d-7d counts
    assert vib[20250109, 1] == (3.06,)  # 2, 4, 8: day 0 is out


def test_pressure_trend_null_without_pressure(spark):
    tel = readings(spark, [(1, t(0), 1, 1, None), (2, t(0), 1, 1, 120), (2, t(1), 1, 1, 126), (2, t(1, 3), 1, 1, None)])
    got = keyed(gold.feature_pressure_trend(tel), "pressure_trend_7d")
    assert got == {(20250101, 1): (None,), (20250101, 2): (0.0,), (20250102, 2): (3.0,)}


def test_service_features_are_strict(spark):
    tel = readings(spark, [(1, t(10), 1, 1, 1), (2, t(10), 1, 1, 1), (3, t(10), 1, 1, 1), (4, t(10), 1, 1, 1), (5, t(10), 1, 1, 1)])
    service = spark.createDataFrame([
        (1, d(10), 3, False), (1, d(8), 3, False), (2, d(10), 1, True), (3, d(17), 1, True), (4, d(18), 1, True), (2, d(3), 1, True)], SERVICE)
    since = keyed(gold.feature_days_since(tel, service), "days_since_last_pm", "days_since_last_failure")
    assert {k[1]: v for k, v in since.items()} == {1: (2, 999), 2: (999, 7), 3: (999, 999), 4: (999, 999), 5: (999, 999)}
    label = keyed(gold.label_next_days(tel, service), "failed_in_next_7_days")
    assert {k[1]: v[0] for k, v in label.items()} == {1: False, 2: False, 3: True, 4: False, 5: False}


def test_feature_store_never_maintained(spark):
    tel = readings(spark, [(1, t(0), 20, 1, 120)])
    assets = spark.createDataFrame([(1, "O", 100.0, True)], "asset_id bigint, oem_name string, downtime_impact_per_hour double, is_current boolean") \
        .withColumn("downtime_impact_per_hour", F.col("downtime_impact_per_hour").cast("decimal(12,2)"))
    wh = Warehouse(spark, {"fct_asset_telemetry": tel, "fct_service_log": spark.createDataFrame([], SERVICE), "dim_asset": assets})
    row = gold.feature_store(wh).first()
    assert row.cycles_since_last_pm == 1_198_800 and row.days_since_last_failure == 999
    assert row.downtime_impact_risk == 1000.0 and row.failed_in_next_7_days is False and row.oem_failure_rate_est is None


def test_hourly_health_single_reading(spark):
    tel = readings(spark, [(1, t(0, 5), 20, 1.234, 120), (1, t(0, 6), 20, 1, 120), (1, t(0, 6), 31, 3, 130)])
    rows = {r.hour_timestamp.hour: r for r in gold.hourly_health(tel).collect()}
    assert rows[5].stddev_pressure_psi is None and rows[5].max_vibration_mm_s == 1.23
    assert rows[6].stddev_pressure_psi == 7.07 and rows[6].avg_temperature_c == 25.5
    late = gold.hourly_health(tel, since="2025-01-01 06:00:00")
    assert late.count() == 1


def test_hot_asset_is_reduced_before_the_window(spark):
    """Raw readings may not reach a window partitioned by asset."""
    tel = readings(spark, [(1, t(0), 1, 1, 1)])
    plan = gold.feature_rows(trailing.observation_axis(tel, spark.createDataFrame([], SERVICE)))._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "hashpartitioning(" in line]
    by_day = [line for line in exchanges if "observation_date" in line or "_groupingexpression" in line or "completed_date" in line]
    assert len(exchanges) == 3 and len(by_day) == 2  # one per daily reduction, one by asset for all windows
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_two_orders_do_not_double_production(spark):
    production = spark.createDataFrame([(1, d(0), 20.0, 18.0, 100, 5)], "asset_id bigint, production_date date, planned_runtime_hours double, "
                                       "actual_runtime_hours double, units_produced bigint, units_scrapped bigint")
    log = spark.createDataFrame([(1, d(0), 1, 3.0, True), (1, d(0), 4, 1.5, False)],
                                "asset_id bigint, completed_date date, wo_type_id int, downtime_hours double, failure_flag boolean")
    wh = Warehouse(spark, {"fct_production_log": production, "fct_maintenance_log": log})
    row = mnt.actual_runtime(wh).first()
    assert (row.planned_hours, row.downtime_hours, row.actual_hours, row.had_failure, row.scrapped) == (20.0, 4.5, 15.5, True, 5)


def test_point_in_time_versions(spark):
    versions = spark.createDataFrame([(1, t(0), t(5), 10), (1, t(5), None, 20)],
                                     "asset_id bigint, scd_start_date timestamp_ntz, scd_end_date timestamp_ntz, impact int")
    facts = spark.createDataFrame([(1, t(4, 23)), (1, t(5)), (1, t(9)), (1, t(-1))], "asset_id bigint, ts timestamp_ntz")
    got = sorted((r.ts, r.impact) for r in joins.at_time(facts, versions, "asset_id", "ts", ["impact"]).collect())
    assert got == [(t(4, 23), 10), (t(5), 20), (t(9), 20)]


def test_star_join_follows_relationships(spark, sample):
    path = [e.parent for e in joins.join_path("fct_maintenance_parts_used", "dim_technician")]
    assert path == ["fct_maintenance_log", "dim_technician"]
    with pytest.raises(ValueError):
        joins.join_path("dim_plant", "dim_asset")
    rows = joins.star_join(sample, "fct_maintenance_parts_used", {"dim_plant": ["plant_name"], "dim_material": ["supplier_name"]})
    assert rows.count() == sample["fct_maintenance_parts_used"].count()
    assert rows.columns == sample["fct_maintenance_parts_used"].columns + ["plant_name", "supplier_name"]


def test_semi_join_and_quality(spark):
    ids = spark.createDataFrame([(1,), (2,), (7,)], "asset_id bigint")
    assert sorted(r.asset_id for r in joins.keep_known(ids, spark.createDataFrame([(1,), (2,), (2,)], "asset_id bigint"), "asset_id").collect()) == [1, 2]
    assert [tuple(r) for r in quality.orphans(ids.union(ids), "asset_id", spark.createDataFrame([(1,), (2,)], "id bigint"), "id").collect()] == [(7, 2)]
    assert [tuple(r) for r in quality.duplicate_keys(ids.union(ids.filter("asset_id = 1")), ["asset_id"]).collect()] == [(1, 2)]
    found = quality.count_violations(ids.union(spark.createDataFrame([(None,)], "asset_id bigint")), {"small": F.col("asset_id") < 5})
    assert [tuple(r) for r in found.collect()] == [(4, "small", 1)]


def test_shape(spark):
    wide = spark.createDataFrame([(1, 2.0, None), (2, None, None)], "id int, a double, b double")
    assert [tuple(r) for r in shape.unpivot_metrics(wide, ["id"], {"a": "A", "b": "B"}).collect()] == [(1, "A", 2.0)]
    rows = spark.range(25).select(F.lit("k").alias("k"), F.col("id"))
    got = shape.gather_chunks(rows, ["k"], F.floor(F.col("id") / 10), F.col("id"), -F.col("id"), "ids").orderBy("chunk_no").collect()
    assert [len(r.ids) for r in got] == [10, 10, 5] and list(got[0].ids) == list(range(9, -1, -1))


def test_python_functions_equal_native(spark, sample):
    bands_native = spark.createDataFrame([(95.0,), (80.0,), (10.0,), (None,)], "v double")
    assert [r[0] for r in bands_native.select(health_band_udf()(F.col("v"))).collect()] == ["excellent", "attention", "immediate", None]
    daily = spark.createDataFrame([("p", 10.0, 9.0, 100.0, 1.0), ("p", 10.0, 8.0, 0.0, 0.0), ("z", 0.0, 0.0, 0.0, 0.0)],
                                  "plant_name string, planned double, actual double, produced double, scrapped double")
    got = {r.plant_name: tuple(r)[1:] for r in oee_by_group(daily).collect()}
    assert got["p"] == (0.85, 0.95, 0.99, pytest.approx(0.799425)) and got["z"] == (0.0, 0.95, 0.0, 0.0)
    spark.udtf.register("steps", steps_udtf())
    rows = spark.sql("SELECT v.n, s.step FROM VALUES (2), (0), (1) AS v(n), LATERAL steps(v.n) s").collect()
    assert sorted(tuple(r) for r in rows) == [(1, 1), (2, 1), (2, 2)]


def test_budget_questions(spark):
    # Two plants' quarterly budgets of two years.
    opex = {(1, 2025): (450, 475, 500, 525), (2, 2025): (550, 580, 600, 625), (1, 2024): (425, 445, 485, 510), (2, 2024): (520, 555, 575, 595)}
    capex = {(1, 2025): (125, 150, 200, 175), (2, 2025): (175, 200, 250, 225)}
    rows = [(p, y, q + 1, kind, v * 1000.0) for kind, table in (("OpEx Maintenance", opex), ("CapEx Project", capex))
            for (p, y), amounts in table.items() for q, v in enumerate(amounts)]
    budget = spark.createDataFrame(rows, "plant_id int, year int, quarter int, budget_type string, budget_amount double")
    plants = spark.createDataFrame([(1, "One"), (2, "Two")], "plant_id int, plant_name string")
    wh = Warehouse(spark, {"fct_budget": budget, "dim_plant": plants})
    assert mnt.budget_total(wh, "OpEx Maintenance", 2025).first()[0] == 4_305_000
    assert mnt.budget_total(wh, "CapEx Project", 2025, 3).first()[0] == 450_000
    share = {r.plant_name: (r.budget_amount, r.share) for r in mnt.budget_share(wh, 2025, "OpEx Maintenance").collect()}
    assert share == {"One": (1_950_000, 0.452962), "Two": (2_355_000, 0.547038)}
    yoy = {(r.plant_name, r.year): r.growth for r in mnt.budget_yoy(wh, "OpEx Maintenance").collect()}
    assert yoy == {("One", 2024): None, ("Two", 2024): None, ("One", 2025): 0.045576, ("Two", 2025): 0.048998}


def test_calendar_first_match_wins(spark):
    assets = spark.createDataFrame([(0, True)], "asset_id bigint, is_current boolean")
    wh = Warehouse(spark, {"dim_asset": assets, "dim_work_order_type": work_order_types(spark)})
    got = {(r.due_date - d(0)).days: (r.wo_type_id, r.technician_id) for r in mnt.maintenance_calendar(wh, d(0), d(60)).collect()}
    assert got == {0: (3, 1), 15: (4, 6), 20: (2, 1), 30: (3, 1), 40: (2, 1), 45: (4, 6), 60: (3, 1)}


def test_deviation_ignores_the_current_day(spark):
    rows = [(1, t(i, h), None, v, None) for i, (h, v) in enumerate([(0, 1.0), (0, 1.2), (0, 0.8), (0, 9.0)])]
    got = trailing.deviation_from_past(readings(spark, rows), 7, 3.0).collect()
    assert [(r.recorded_at, round(r.past_mean, 4)) for r in got] == [(t(3), 1.0)]


def test_partitioning_does_not_change_results(spark, sample):
    wide = sample.with_tables(fct_production_log=lambda wh: sample["fct_production_log"].repartition(17),
                              fct_asset_telemetry=lambda wh: sample["fct_asset_telemetry"].repartition(13))
    for plan in (prod.oee_by_plant, prod.scrap_rate, gold.feature_store):
        assert sorted(map(tuple, plan(sample).collect()), key=repr) == sorted(map(tuple, plan(wide).collect()), key=repr)
