"""Telemetry of assets and lines: latest readings, sensor status, factory tree, flow."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantpulse.functions import bands
from plantpulse.functions.dates import as_date, as_ntz, hour_start
from plantpulse.functions.numeric import half_up
from plantpulse.functions.python_functions import steps_udtf
from plantpulse.functions.text import hourly_cost_text, path_level, percent_text
from plantpulse.operators.intervals import trailing_join
from plantpulse.operators.joins import at_time, place_assets
from plantpulse.operators.latest import latest_per_key, order_key
from plantpulse.operators.ordered import lead_in_pieces, sessions
from plantpulse.operators.shape import gather_chunks, unpivot_metrics
from plantpulse.sources.shared import materialise
from plantpulse.warehouse import Warehouse

# Telemetry columns as sensor types, with units and id suffix.
METRICS = {"temperature_c": "Temperature", "vibration_mm_s": "Vibration", "pressure_psi": "Pressure"}
UNITS = {"Temperature": "°C", "Vibration": "mm/s", "Pressure": "PSI"}
SUFFIX = {"Temperature": "temp", "Vibration": "vib", "Pressure": "pres"}
PREDICTION = ("health_score", "failure_probability", "rul_days", "is_anomalous")
ASSETS_PER_DOCUMENT = 500


def _d(name: str) -> Column:
    return F.col(name).cast("double").alias(name)


def plants(wh: Warehouse) -> DataFrame:
    return wh["dim_plant"].select("plant_name").distinct().orderBy("plant_name")


def lines(wh: Warehouse, plant_name: str) -> DataFrame:
    """Line names of a plant, through a bound SQL parameter."""
    return wh.spark.sql(
        "SELECT DISTINCT l.line_name FROM {line} l JOIN {plant} p ON l.plant_id = p.plant_id "
        "WHERE p.plant_name = :plant ORDER BY l.line_name",
        args={"plant": plant_name}, line=wh["dim_line"], plant=wh["dim_plant"])


def line_assets(wh: Warehouse, line_name: str | None = None) -> DataFrame:
    assets = place_assets(wh["dim_asset"], wh, ["line_name", "process_id", "process_name", "asset_name"])
    if line_name is not None:
        assets = assets.filter(F.col("line_name") == line_name)
    return assets.distinct()


def telemetry_pivot(wh: Warehouse) -> DataFrame:
    """Asset-hour rows with one column per metric."""
    return (wh["fct_asset_telemetry"].groupBy("asset_id", hour_start("recorded_at").alias("hour_timestamp"))
            .agg(*[half_up(F.sum(c).cast("double") / F.when(F.count(c) > 0, F.count(c)), 2).alias(c) for c in METRICS]))


def latest_telemetry(wh: Warehouse, asset_ids: list[int] | None = None) -> DataFrame:
    """Last known value of each metric per asset, whenever it was read."""
    rows = wh["fct_asset_telemetry"]
    if asset_ids is not None:
        rows = rows.filter(F.col("asset_id").isin(asset_ids))
    return _keyed(rows, METRICS).groupBy("asset_id").agg(*_latest_metrics())


def _keyed(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.select("asset_id", *columns, order_key(F.col("recorded_at"), F.col("telemetry_id")).alias("__key"))


def _latest_metrics() -> list[Column]:
    """Last known value of each metric, in the order of time and id."""
    return [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("__key"))).cast("double").alias(c) for c in METRICS]


def latest_prediction(wh: Warehouse, asset_ids: list[int] | None = None) -> DataFrame:
    rows = wh["fct_asset_telemetry"]
    if asset_ids is not None:
        rows = rows.filter(F.col("asset_id").isin(asset_ids))
    last = latest_per_key(rows, ["asset_id"], "recorded_at", list(PREDICTION), ["telemetry_id"])
    return last.select("asset_id", "recorded_at", _d("health_score"), _d("failure_probability"), "rul_days",
                       "is_anomalous")


def latest_state(wh: Warehouse) -> DataFrame:
    """Last value of every metric and last prediction per asset, in one pass over the readings."""
    last = _keyed(wh["fct_asset_telemetry"], [*METRICS, *PREDICTION]).groupBy("asset_id").agg(
        *_latest_metrics(), *[F.max_by(c, "__key").alias(c) for c in PREDICTION])
    return last.select("asset_id", *METRICS, _d("health_score"), _d("failure_probability"), "rul_days", "is_anomalous")


def sensor_status(wh: Warehouse) -> DataFrame:
    """Latest reading per asset and sensor type with its band."""
    long = unpivot_metrics(latest_telemetry(wh), ["asset_id"], METRICS)
    return long.withColumn("status", bands.sensor_status(F.col("sensor_type"), F.col("value")))


def _status_columns() -> list[Column]:
    """Page figures of an asset; what is missing takes the page defaults."""
    health = F.coalesce(F.col("health_score") / 100, F.lit(bands.DEFAULT_HEALTH_01))
    cost = F.coalesce(F.col("downtime_impact_per_hour").cast("double"), F.lit(float(bands.DEFAULT_DOWNTIME_COST)))
    return [half_up(health, 4).alias("health_score01"), bands.asset_status(health, F.col("is_anomalous")).alias("status"),
            bands.health_colour(health).alias("colour"),
            percent_text(F.coalesce("failure_probability", F.lit(bands.DEFAULT_PROBABILITY))).alias("failure_text"),
            hourly_cost_text(cost).alias("cost_text"),
            F.coalesce("rul_days", F.lit(bands.DEFAULT_RUL_DAYS)).alias("rul_days")]


def asset_status(wh: Warehouse) -> DataFrame:
    """Status of every current asset, with or without telemetry."""
    assets = wh.current_assets().select("asset_id", "downtime_impact_per_hour")
    return assets.join(latest_prediction(wh), "asset_id", "left").select("asset_id", *_status_columns())


def rule_scores(wh: Warehouse, installed: dt.date | str) -> DataFrame:
    """Rule-based health, probability and life of every reading, by days since a start and hour of day."""
    days = F.datediff("recorded_at", F.lit(str(installed)).cast("date"))
    load = F.coalesce(F.col("temperature_c").cast("double") / 100.0, F.lit(0.0))
    scored = wh["fct_asset_telemetry"].select(
        "telemetry_id", days.alias("days"), bands.rule_health_score(days, F.hour("recorded_at"), load).alias("rule_health"))
    return scored.select("telemetry_id", "rule_health", bands.rule_failure_probability(F.col("rule_health")).alias("rule_probability"),
                         bands.rule_rul_days(F.col("days")).alias("rule_rul_days"))


def anomaly_flags(wh: Warehouse, rotating_class: str) -> DataFrame:
    """Readings flagged by the rule (low health, or high vibration on rotating equipment)."""
    rotating = wh.current_assets().join(wh["dim_asset_class"], "asset_class_id").select(
        "asset_id", (F.col("class_name") == rotating_class).alias("rotating"))
    flagged = wh["fct_asset_telemetry"].join(rotating, "asset_id").filter(
        bands.is_anomaly(F.col("health_score"), F.col("vibration_mm_s"), F.col("rotating")))
    return flagged.select("telemetry_id", "asset_id", "recorded_at", _d("health_score"), _d("vibration_mm_s"), "rotating")


def sensor_readings(wh: Warehouse, asset_id: int, start: dt.datetime | str, end: dt.datetime | str) -> DataFrame:
    """Every sensor of the asset with every wide reading (each reading repeats per sensor)."""
    readings = wh["fct_asset_telemetry"].filter(
        (F.col("asset_id") == asset_id) & F.col("recorded_at").between(as_ntz(start), as_ntz(end)))
    sensors = wh["dim_sensor"].filter(F.col("asset_id") == asset_id)
    return sensors.join(readings, "asset_id").select(
        "sensor_sk", "sensor_nk", "sensor_type", "units_of_measure", "recorded_at", *[_d(c) for c in METRICS],
        _d("health_score"), _d("failure_probability"), "rul_days", "is_anomalous").orderBy(
        F.col("recorded_at").desc(), "sensor_sk")


def _long_readings(wh: Warehouse, rows: DataFrame) -> DataFrame:
    """One row per actual sensor reading, with the sensor it belongs to."""
    long = unpivot_metrics(rows, ["telemetry_id", "asset_id", "recorded_at"], METRICS)
    sensors = wh["dim_sensor"].select("sensor_sk", "asset_id", "sensor_type", "units_of_measure")
    return long.join(sensors, ["asset_id", "sensor_type"])


def sensor_readings_by_metric(wh: Warehouse, start: dt.datetime | str, end: dt.datetime | str) -> DataFrame:
    """Corrected form: each reading once, joined to its own sensor."""
    rows = wh["fct_asset_telemetry"].filter(F.col("recorded_at").between(as_ntz(start), as_ntz(end)))
    return _long_readings(wh, rows).select("sensor_sk", "telemetry_id", "recorded_at", "sensor_type", "value")


def latest_reading_per_sensor(wh: Warehouse) -> DataFrame:
    long = unpivot_metrics(wh["fct_asset_telemetry"], ["telemetry_id", "asset_id", "recorded_at"], METRICS)
    last = latest_per_key(long, ["asset_id", "sensor_type"], "recorded_at", ["value"], ["telemetry_id"])
    sensors = wh["dim_sensor"].select("sensor_sk", "asset_id", "sensor_type")
    return last.join(sensors, ["asset_id", "sensor_type"]).select("sensor_sk", "sensor_type", "recorded_at", "value")


def _recent_long(wh: Warehouse, as_of: dt.datetime | str, hours: int) -> DataFrame:
    return unpivot_metrics(wh.last_hours("fct_asset_telemetry", as_of, hours), ["asset_id"], METRICS)


def _with_sensor(wh: Warehouse, per_sensor: DataFrame) -> DataFrame:
    """Sensor key for rows already reduced to one per (asset, sensor type).

    A merge join: sensors can be many more rows than their file's size tells, too many to broadcast.
    """
    sensors = wh["dim_sensor"].select("sensor_sk", "asset_id", "sensor_type")
    return per_sensor.join(sensors.hint("merge"), ["asset_id", "sensor_type"])


def out_of_range(wh: Warehouse, as_of: dt.datetime | str, hours: int = 24) -> DataFrame:
    """Sensors with readings outside the normal band in the last hours."""
    rows = _recent_long(wh, as_of, hours).withColumn("status", bands.sensor_status(F.col("sensor_type"), F.col("value")))
    counts = rows.filter("status <> 'normal'").groupBy("asset_id", "sensor_type").agg(
        F.count(F.lit(1)).alias("readings"), F.count_if(F.col("status") == "critical").alias("critical_readings"))
    return _with_sensor(wh, counts).select("sensor_sk", "sensor_type", "readings", "critical_readings")


def _hot(wh: Warehouse, as_of: dt.datetime | str, above: float, hours: int) -> DataFrame:
    rows = _recent_long(wh, as_of, hours)
    hot = rows.filter((F.col("sensor_type") == "Temperature") & (F.col("value") > above))
    return _with_sensor(wh, hot.select("asset_id", "sensor_type").distinct())


def hot_sensors(wh: Warehouse, as_of: dt.datetime | str, above: float = 70, hours: int = 168) -> DataFrame:
    """How many temperature sensors read above a bound."""
    return _hot(wh, as_of, above, hours).agg(F.countDistinct("sensor_sk").alias("sensors"))


def hot_sensors_approx(wh: Warehouse, as_of: dt.datetime | str, above: float = 70, hours: int = 168) -> DataFrame:
    """The same by sketch, for counts where a few percent do not matter."""
    return _hot(wh, as_of, above, hours).agg(F.approx_count_distinct("sensor_sk", 0.01).alias("sensors"))


def anomaly_sessions(wh: Warehouse, gap_minutes: int = 720) -> DataFrame:
    """Runs of anomalous readings per asset."""
    flagged = wh["fct_asset_telemetry"].filter(F.col("is_anomalous")).select("asset_id", "recorded_at")
    return sessions(flagged, ["asset_id"], "recorded_at", gap_minutes)


def scd2_point_in_time(wh: Warehouse) -> DataFrame:
    """Risk of the readings with the asset version valid at their time, by current and past versions."""
    rows = wh["fct_asset_telemetry"].select("asset_id", "recorded_at", "failure_probability")
    joined = at_time(rows, wh.asset_versions(), "asset_id", "recorded_at", ["is_current", "downtime_impact_per_hour"])
    then = F.col("failure_probability") * F.col("downtime_impact_per_hour")
    return joined.groupBy("is_current", F.to_date("recorded_at").alias("reading_date")).agg(
        F.count(F.lit(1)).alias("readings"), F.sum(then).cast("double").alias("risk_value"))


def flow_edges(wh: Warehouse) -> DataFrame:
    """Each asset to the next one of its process, in process order."""
    assets = wh.current_assets().select("process_id", "process_sequence", "asset_id")
    piece = F.struct("process_sequence", F.floor(F.col("asset_id") / 100_000).alias("b"))
    edges = lead_in_pieces(assets, ["process_id"], ["process_sequence", "asset_id"], piece, "asset_id", "next_asset_id")
    return edges.filter(F.col("next_asset_id").isNotNull()).select("process_id", "asset_id", "next_asset_id")


def process_edges(wh: Warehouse) -> DataFrame:
    """Each process to the next one of its line."""
    rows = wh["dim_process"].select("line_id", "process_id")
    edges = lead_in_pieces(rows, ["line_id"], ["process_id"], F.floor(F.col("process_id") / 100_000), "process_id",
                           "next_process_id")
    return edges.filter(F.col("next_process_id").isNotNull()).select("line_id", "process_id", "next_process_id")


def path_levels(wh: Warehouse) -> DataFrame:
    """Levels of the asset path key, counted per line and process segment."""
    path = F.col("asset_path")
    return wh.current_assets().groupBy(path_level(path, 1).alias("line_key"), path_level(path, 2).alias("process_key")).agg(
        F.count(F.lit(1)).alias("assets"), F.max(path_level(path, 3)).alias("last_asset"))


def _asset_documents(wh: Warehouse, plant_name: str | None, line_name: str | None) -> DataFrame:
    """One nested asset document per asset, sensors inside (three at most)."""
    place = ["plant_name", "line_name", "process_id", "process_name"]
    placed = place_assets(wh.current_assets(), wh, [*place, "asset_name", "downtime_impact_per_hour"])
    if plant_name is not None:
        placed = placed.filter(F.col("plant_name") == plant_name)
    if line_name is not None:
        placed = placed.filter(F.col("line_name") == line_name)
    sensor = [
        F.when(F.col(c).isNotNull(), F.struct(
            F.concat(F.lit("sensor_"), F.col("asset_id").cast("string"), F.lit("_" + SUFFIX[t])).alias("id"),
            F.lit(t).alias("type"), half_up(F.col(c), 2).alias("value"), F.lit(UNITS[t]).alias("unit"),
            bands.sensor_status(F.lit(t), F.col(c)).alias("status")))
        for c, t in METRICS.items()
    ]
    rows = placed.join(latest_state(wh), "asset_id", "left").select(
        "asset_id", "asset_name", *place, *METRICS, *_status_columns())
    document = F.struct(
        F.concat(F.lit("asset_"), F.col("asset_id").cast("string")).alias("id"), F.col("asset_name").alias("name"),
        F.lit("asset").alias("type"), F.col("health_score01").alias("healthScore"), "status",
        F.col("failure_text").alias("pof"), F.col("cost_text").alias("cost"),
        F.filter(F.array(*sensor), lambda s: s.isNotNull()).alias("children"))
    return rows.select("plant_name", "line_name", "process_id", "process_name", "asset_id", document.alias("document"))


def factory_tree(wh: Warehouse, plant_name: str | None = None, line_name: str | None = None) -> DataFrame:
    """Process nodes of the plant -> line -> process -> asset -> sensor tree as JSON.

    A node holds at most as many assets as one id range has (``ASSETS_PER_DOCUMENT``), so
    a process of any size becomes several nodes with the same id and rising ``chunk_no``.
    """
    assets = _asset_documents(wh, plant_name, line_name)
    keys = ["plant_name", "line_name", "process_id", "process_name"]
    chunk = F.floor(F.col("asset_id") / ASSETS_PER_DOCUMENT)
    nodes = gather_chunks(assets, keys, chunk, F.col("document"), F.col("asset_id"), "children")
    node = F.struct(F.concat(F.lit("proc_"), F.col("process_id").cast("string")).alias("id"),
                    F.col("process_name").alias("name"), F.lit("process").alias("type"), F.col("children"))
    text = F.to_json(node)
    return nodes.select("plant_name", "line_name", "process_id", "chunk_no", F.size("children").alias("assets"),
                        text.alias("node"), F.md5(text).alias("node_md5"))


def tree_read_back(nodes: DataFrame) -> DataFrame:
    """The assets that tree nodes hold, parsed from their JSON: one row per asset with its sensors counted."""
    kind = "struct<id: string, children: array<struct<id: string, name: string, status: string, children: array<struct<id: string>>>>>"
    node = F.from_json("node", kind)
    rows = nodes.select("plant_name", "line_name", node["id"].alias("process"), F.explode(node["children"]).alias("a"),
                        (F.md5("node") == F.col("node_md5")).alias("intact"))
    return rows.select("plant_name", "line_name", "process", F.col("a.id").alias("asset"), F.col("a.name").alias("asset_name"),
                       F.size("a.children").cast("bigint").alias("sensors"), "intact")


def hot_sensors_compared(wh: Warehouse, as_of: dt.datetime | str, above: float = 70, hours: int = 168) -> DataFrame:
    """The exact number and whether the sketch comes within three percent of it.

    Sensors are made distinct first: a distinct count beside a sketch would keep a sketch for every sensor.
    """
    exact, sketch = F.count("sensor_sk"), F.approx_count_distinct("sensor_sk", 0.01)
    return _hot(wh, as_of, above, hours).select("sensor_sk").distinct().agg(exact.alias("sensors"), (F.abs(sketch - exact) <= 0.03 * exact).alias("sketch_is_close"))


def tree_counts(wh: Warehouse) -> DataFrame:
    """Assets and live sensors per process of the tree."""
    keys = ["plant_name", "line_name", "process_name"]
    return _asset_documents(wh, None, None).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("assets"), F.sum(F.size("document.children")).alias("sensors"))


def temperature_before_hours(wh: Warehouse, hours: int = 24) -> DataFrame:
    """For each hour in which an asset was read: the exact mean temperature of the hours before its end.

    Hour-exact, where the daily feature covers whole days.
    """
    rows = wh["fct_asset_telemetry"]
    ends = rows.select("asset_id", hour_start("recorded_at").alias("h")).distinct().select("asset_id", F.expr("timestampadd(HOUR, 1, h)").alias("hour_end"))
    readings = rows.filter(F.col("temperature_c").isNotNull()).select("asset_id", "recorded_at", "temperature_c")
    met = trailing_join(ends, readings, "asset_id", "hour_end", "recorded_at", hours)
    return met.groupBy("asset_id", "hour_end").agg(F.sum("temperature_c").alias("s"), F.count("temperature_c").alias("readings")).select(
        "asset_id", "hour_end", half_up(F.col("s").cast("double") / F.col("readings"), 2).alias("avg_temperature_c"), "readings")


def sensor_sketches(wh: Warehouse) -> DataFrame:
    """One mergeable sketch of the assets read per sensor type and day."""
    long = unpivot_metrics(wh["fct_asset_telemetry"], ["asset_id", "recorded_at"], METRICS)
    return long.groupBy("sensor_type", F.to_date("recorded_at").alias("day")).agg(F.hll_sketch_agg("asset_id", 14).alias("sketch"))


def assets_read_between(sketches: DataFrame, first: dt.date | str, last: dt.date | str) -> DataFrame:
    """Estimated number of assets read per sensor type in a range of days, from the stored sketches alone."""
    days = sketches.filter(F.col("day").between(as_date(first), as_date(last)))
    return days.groupBy("sensor_type").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("assets"))


def sketches_compared(wh: Warehouse, ranges: Sequence[tuple[str, str]]) -> DataFrame:
    """For several ranges: exact number of assets per sensor type, and whether the stored sketches come within 3 %."""
    sketches = materialise(sensor_sketches(wh), "sketches")
    long = unpivot_metrics(wh["fct_asset_telemetry"], ["asset_id", "recorded_at"], METRICS)
    out = []
    for first, last in ranges:
        exact = long.filter(F.to_date("recorded_at").between(as_date(first), as_date(last))).groupBy("sensor_type").agg(F.count_distinct("asset_id").alias("exact"))
        both = exact.join(assets_read_between(sketches, first, last), "sensor_type")
        out.append(both.select(F.lit(first).alias("first_day"), F.lit(last).alias("last_day"), "sensor_type", "exact",
                               (F.abs(F.col("assets") - F.col("exact")) <= 0.03 * F.col("exact")).alias("within_3_percent")))
    return reduce(DataFrame.unionByName, out)


def repeated_positions(wh: Warehouse) -> DataFrame:
    """Each current asset once per step of its place in the process: a table function called with a column of its row."""
    spark = wh.spark
    spark.udtf.register("steps", steps_udtf())
    return spark.sql("SELECT asset_id, s.step FROM {assets}, LATERAL steps(process_sequence) s",
                     assets=wh.current_assets().select("asset_id", "process_sequence"))
