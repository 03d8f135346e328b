"""The sample star schema (orders, lineitem, events, ...) read as a maintenance warehouse.

Each function is a projection of one sample table onto a table of :mod:`plantpulse.schemas`;
no rows are dropped except where a table's meaning is a kind of event. Decimal widths are
chosen so that sums stay on Spark's long-backed path where the values allow it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantpulse.plans.gold import feature_store, hourly_health
from plantpulse.schemas import TABLES
from plantpulse.sources.dimensions import calendar_labels, failure_codes, literal_table, work_order_types
from plantpulse.warehouse import TIME_COLUMNS, Warehouse, latest_hours

# The days the sample data ends, which play "today".
TELEMETRY_NOW = "2024-01-30 23:59:59"
TELEMETRY_TODAY = "2024-01-30"
OPERATIONS_TODAY = "2001-08-01"

# Segment number and process type of each asset class.
ASSET_CLASSES = [
    (1, "AUTOMOBILE", "Manufacturing"),
    (2, "BUILDING", "Assembly"),
    (3, "FURNITURE", "Testing"),
    (4, "HOUSEHOLD", "Manufacturing"),
    (5, "MACHINERY", "Assembly"),
]
ROTATING_CLASS = "MACHINERY"

# Event types that play sensors and work orders.
METRIC_EVENTS = {"view": "temperature_c", "click": "vibration_mm_s", "signup": "pressure_psi"}
SENSOR_TYPES = [("Temperature", "Celsius"), ("Vibration", "mm/s"), ("Pressure", "PSI")]

_SEGMENT = ("CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 3 "
            "WHEN 'HOUSEHOLD' THEN 4 ELSE 5 END")


# Column types of the sample files. Giving them saves a footer-reading job per table.
SAMPLE_DDL = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
                "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
                "l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}


def _sample(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SAMPLE_DDL[name]).parquet(f"{sf_dir}/{name}.parquet")


def plant(region: DataFrame) -> DataFrame:
    return region.selectExpr("r_regionkey AS plant_id", "r_name AS plant_name", "r_name AS location",
                             "lower(r_name) AS plant_path")


def line(nation: DataFrame) -> DataFrame:
    return nation.selectExpr("n_nationkey AS line_id", "n_regionkey AS plant_id", "n_name AS line_name",
                             "cast(10000 + 500 * n_nationkey AS decimal(10,2)) AS hourly_revenue",
                             "lower(n_name) AS line_path")


def asset_class(spark: SparkSession) -> DataFrame:
    return literal_table(spark, [c[:2] for c in ASSET_CLASSES], TABLES["dim_asset_class"].ddl)


def process(nation: DataFrame) -> DataFrame:
    """Five processes per line, one for each asset class."""
    steps = ", ".join(f"named_struct('n', {n}, 'name', '{name}', 'kind', '{kind}')" for n, name, kind in ASSET_CLASSES)
    return nation.selectExpr("n_nationkey", "n_name", f"explode(array({steps})) AS s").selectExpr(
        "n_nationkey * 10 + s.n AS process_id", "concat('proc_', n_nationkey * 10 + s.n) AS process_nk",
        "concat(n_name, ' ', s.name) AS process_name", "s.kind AS process_type", "n_nationkey AS line_id",
        "lower(concat(n_name, '/', s.name)) AS process_path", "s.name AS description", "true AS is_active")


def asset(customer: DataFrame) -> DataFrame:
    return customer.selectExpr(
        "c_custkey AS asset_id", "concat('eq_', c_custkey) AS asset_nk", "c_name AS asset_name",
        "concat('Model ', c_custkey % 20) AS model", "concat('OEM ', c_custkey % 8) AS oem_name",
        f"c_nationkey * 10 + {_SEGMENT} AS process_id", "cast(c_custkey % 5 + 1 AS int) AS process_sequence",
        f"{_SEGMENT} AS asset_class_id", "date_add(DATE'2015-01-01', cast(c_custkey % 2500 AS int)) AS installation_date",
        "cast(abs(c_acctbal) AS decimal(12,2)) AS downtime_impact_per_hour",
        "concat('site/', c_nationkey, '/', lower(c_mktsegment), '/eq_', c_custkey) AS asset_path",
        "TIMESTAMP_NTZ'2015-01-01 00:00:00' AS scd_start_date", "cast(NULL AS timestamp_ntz) AS scd_end_date",
        "true AS is_current")


def asset_versions(assets: DataFrame) -> DataFrame:
    """Two versions per asset: 80 % of the impact up to a day of January 2024, all of it from then on."""
    at = "timestampadd(DAY, cast(asset_id % 30 AS int), TIMESTAMP_NTZ'2024-01-01 00:00:00')"
    both = assets.drop("scd_start_date", "scd_end_date", "is_current").withColumn("version", F.explode(F.array(F.lit(1), F.lit(2))))
    return (both.withColumn("downtime_impact_per_hour", F.expr(
                "cast(CASE version WHEN 1 THEN downtime_impact_per_hour * 0.8 ELSE downtime_impact_per_hour END AS decimal(14,3))"))
            .withColumn("scd_start_date", F.expr(f"CASE version WHEN 2 THEN {at} ELSE TIMESTAMP_NTZ'2015-01-01 00:00:00' END"))
            .withColumn("scd_end_date", F.expr(f"CASE version WHEN 1 THEN {at} END"))
            .withColumn("is_current", F.col("version") == 2))


def machine(supplier: DataFrame) -> DataFrame:
    """Assets of the production log."""
    return supplier.selectExpr(
        "s_suppkey AS asset_id", "concat('mc_', s_suppkey) AS asset_nk", "s_name AS asset_name",
        "concat('Model ', s_suppkey % 20) AS model", "concat('OEM ', s_suppkey % 8) AS oem_name",
        "cast(s_nationkey * 10 + s_suppkey % 5 + 1 AS int) AS process_id", "1 AS process_sequence",
        "cast(s_suppkey % 5 + 1 AS int) AS asset_class_id",
        "date_add(DATE'2015-01-01', cast(s_suppkey % 2500 AS int)) AS installation_date",
        "cast(abs(s_acctbal) AS decimal(12,2)) AS downtime_impact_per_hour",
        "concat('site/', s_nationkey, '/mc_', s_suppkey) AS asset_path",
        "TIMESTAMP_NTZ'2015-01-01 00:00:00' AS scd_start_date", "cast(NULL AS timestamp_ntz) AS scd_end_date",
        "true AS is_current")


def sensor(assets: DataFrame) -> DataFrame:
    """Three sensors per asset."""
    kinds = ", ".join(f"named_struct('i', {i}, 't', '{t}', 'u', '{u}')" for i, (t, u) in enumerate(SENSOR_TYPES))
    return assets.selectExpr("asset_id", "asset_nk", "asset_path", f"explode(array({kinds})) AS k").selectExpr(
        "asset_id * 3 + k.i AS sensor_sk", "concat(asset_nk, '_', lower(k.t)) AS sensor_nk", "asset_id",
        "k.t AS sensor_type", "k.u AS units_of_measure", "concat(asset_path, '/', lower(k.t)) AS sensor_path")


def technician(supplier: DataFrame) -> DataFrame:
    return supplier.selectExpr(
        "s_suppkey AS technician_id", "concat('EMP', s_suppkey) AS employee_nk", "s_name AS technician_name",
        "element_at(array('Mechanic', 'Electrician', 'Instrumentation'), cast(s_suppkey % 3 + 1 AS int)) AS craft",
        "element_at(array('Day', 'Evening', 'Night'), cast(s_suppkey % 7 % 3 + 1 AS int)) AS shift",
        "date_add(DATE'2018-01-01', cast(s_suppkey % 1000 AS int)) AS hire_date", "true AS is_active")


def material(part: DataFrame) -> DataFrame:
    return part.selectExpr("p_partkey AS material_id", "concat(p_type, '-', p_partkey) AS material_nk",
                           "p_name AS material_desc", "p_brand AS supplier_name",
                           "cast(p_retailprice AS decimal(10,2)) AS unit_cost")


def telemetry(events: DataFrame) -> DataFrame:
    """One reading per event; the event type says which metric it carries."""
    health = "cast(floor((100D - least(60D, value / 4D)) * 100D + 0.5D) / 100D AS decimal(5,2))"
    prob = "cast(floor(least(0.99D, 0.01D + value / 300D) * 100D + 0.5D) / 100D AS decimal(3,2))"
    vib = "cast(CASE WHEN event_type = 'click' THEN value / 100D END AS decimal(8,4))"
    return events.selectExpr(
        "event_id AS telemetry_id", "user_id AS asset_id", "cast(NULL AS int) AS process_id",
        "year(ts) * 10000 + month(ts) * 100 + day(ts) AS date_sk", "ts AS recorded_at",
        "cast(CASE WHEN event_type = 'view' THEN value END AS decimal(6,2)) AS temperature_c",
        f"{vib} AS vibration_mm_s",
        "cast(CASE WHEN event_type = 'signup' THEN value + 100D END AS decimal(6,2)) AS pressure_psi",
        f"{health} AS health_score", f"{prob} AS failure_probability",
        "1 + from_json(props, 'k INT').k AS rul_days",
        f"({health} < 80 OR coalesce({vib} > 1.2, false)) AS is_anomalous")


def service_log(events: DataFrame) -> DataFrame:
    """Preventive work and failures of the telemetry assets, as work orders."""
    return events.filter(F.col("event_type").isin("purchase", "error")).selectExpr(
        "event_id AS log_id", "user_id AS asset_id",
        "CASE event_type WHEN 'purchase' THEN 3 ELSE 1 END AS wo_type_id", "cast(ts AS date) AS completed_date",
        "event_type = 'error' AS failure_flag")


def maintenance(orders: DataFrame) -> DataFrame:
    return orders.selectExpr(
        "o_orderkey AS log_id", "o_custkey AS asset_id",
        "CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE 4 END AS wo_type_id",
        "year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS action_date_sk",
        "cast(o_orderdate AS date) AS completed_date", "o_orderdate AS source_ts",
        "cast(floor(o_totalprice / 1000D) / 10D AS decimal(5,1)) AS downtime_hours",
        "cast(o_totalprice AS decimal(10,2)) - cast(floor(o_totalprice * 40D) / 100D AS decimal(10,2)) AS parts_cost",
        "cast(floor(o_totalprice * 40D) / 100D AS decimal(10,2)) AS labor_cost",
        "o_orderpriority = '1-URGENT' AS failure_flag", "o_orderkey % 10 AS technician_id",
        "CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey % 12 + 1 END AS failure_code_id",
        "concat('Work order ', o_orderkey, ' closed with status ', o_orderstatus) AS technician_notes")


def production(lineitem: DataFrame) -> DataFrame:
    return lineitem.selectExpr(
        "l_suppkey AS asset_id", "cast(l_shipdate AS date) AS production_date", "l_shipdate AS source_ts",
        "l_quantity AS planned_runtime_hours", "l_quantity * (1D - l_discount) AS actual_runtime_hours",
        "cast(floor(l_extendedprice + 0.5D) AS bigint) AS units_produced",
        "cast(floor(l_extendedprice * l_tax + 0.5D) AS bigint) AS units_scrapped")


def parts_used(lineitem: DataFrame) -> DataFrame:
    return lineitem.selectExpr("l_orderkey AS log_id", "l_partkey AS material_id",
                               "cast(l_quantity AS decimal(8,2)) AS quantity_used",
                               "cast(l_extendedprice AS decimal(10,2)) AS total_cost")


def budget(wh: Warehouse) -> DataFrame:
    """Next year's budget of a plant and quarter is what was spent in the same quarter this year."""
    spent = (wh["fct_maintenance_log"]
             .groupBy("asset_id", F.year("completed_date").alias("y"), F.quarter("completed_date").alias("quarter"),
                      F.when(F.col("wo_type_id") <= 2, "CapEx Project").otherwise("OpEx Maintenance").alias("budget_type"))
             .agg(F.sum(F.col("parts_cost") + F.col("labor_cost")).alias("spent")))
    place = (wh["dim_asset"].select("asset_id", "process_id")
             .join(wh["dim_process"].select("process_id", "line_id"), "process_id")
             .join(wh["dim_line"].select("line_id", "plant_id"), "line_id").select("asset_id", "plant_id"))
    return (spent.join(place, "asset_id")
            .groupBy("plant_id", (F.col("y") + 1).alias("year"), "quarter", "budget_type")
            .agg(F.sum("spent").cast("decimal(18,2)").alias("budget_amount")))


def raw_telemetry(events: DataFrame) -> DataFrame:
    """The events as JSON messages, with the kinds of damage a feed shows.

    Truncated text, a word for a number, a missing device, a device that no asset answers to: told by
    the event id, so the expected rejects are known.
    """
    broken, wordy, nameless, unknown = "event_id % 97 = 5", "event_id % 89 = 7", "event_id % 83 = 9", "event_id % 71 = 3"
    payload = F.concat(
        F.lit('{ "metric": "'), F.col("event_type"), F.lit('", "value": '),
        F.when(F.expr(wordy), F.lit('"n/a"')).otherwise(F.col("value").cast("string")),
        F.when(F.expr(nameless), F.lit("")).otherwise(
            F.concat(F.when(F.expr(unknown), ', "deviceId": "old_').otherwise(', "deviceId": "eq_'), F.col("user_id").cast("string"), F.lit('"'))),
        F.when(F.expr(broken), F.lit(', "unit": ')).otherwise(F.lit(', "unit": "x" }')))
    return events.select("event_id", payload.alias("raw_payload"), F.col("ts").alias("source_timestamp"))


def raw_maintenance(wh: Warehouse) -> DataFrame:
    """Work orders written as JSON messages, some cut off or without a date."""
    rows = wh["fct_maintenance_log"].join(wh["dim_work_order_type"], "wo_type_id")
    return rows.select(F.to_json(F.struct(
        F.concat(F.lit("WO-"), F.col("log_id").cast("string")).alias("workOrderId"),
        F.concat(F.lit("eq_"), F.col("asset_id").cast("string")).alias("assetId"), F.col("wo_type_code").alias("type"),
        F.col("technician_notes").alias("notes"), F.col("downtime_hours").alias("downtimeHours"),
        F.col("labor_cost").alias("laborCost"), F.col("parts_cost").alias("partsCost"),
        F.col("failure_flag").alias("failure"), F.when(F.expr("log_id % 53 <> 9"), F.date_format("completed_date", "yyyy-MM-dd")).alias("date"))).alias("log_data"),
        "log_id").select(F.when(F.expr("log_id % 61 = 7"), F.expr("left(log_data, 20)")).otherwise(F.col("log_data")).alias("log_data"))


def raw_equipment(wh: Warehouse) -> DataFrame:
    """The assets as JSON messages, some without a serial number."""
    return wh.current_assets().select(F.to_json(F.struct(
        F.when(F.expr("asset_id % 41 <> 5"), F.col("asset_nk")).alias("serialNumber"), "model", F.col("oem_name").alias("oem"),
        F.date_format("installation_date", "yyyy-MM-dd").alias("installDate"),
        F.lit("Machine").alias("assetType"), F.lit("Site").alias("plant"))).alias("equipment_data"))


def raw_equipment_feed(wh: Warehouse) -> DataFrame:
    """Five messages per asset over time: the first, one that repeats it, two that may change something, and one that
    arrives last and corrects the past (or only repeats)."""
    base = "TIMESTAMP_NTZ'2023-01-01 00:00:00'"
    model = "CASE WHEN k = 3 AND asset_id % 4 = 0 THEN 'Model new' WHEN k = 4 AND asset_id % 5 = 0 THEN 'Model corrected' ELSE model END"
    oem = "CASE WHEN k IN (2, 3, 4) AND asset_id % 3 = 0 AND NOT (k = 4 AND asset_id % 5 = 0) THEN 'OEM next' ELSE oem_name END"
    days = "asset_id % 20 + CASE WHEN k = 4 AND asset_id % 5 = 0 THEN 90 WHEN k = 4 THEN 120 ELSE 60 * k END"
    rows = wh.current_assets().select("asset_id", "asset_nk", "model", "oem_name", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k")).select(
        "asset_nk", F.expr(model).alias("model"), F.expr(oem).alias("oem"),
        F.expr(f"timestampadd(DAY, cast({days} AS int), {base})").alias("at"),
        F.expr(f"timestampadd(DAY, cast(asset_id % 20 + 70 * k AS int), {base})").alias("arrived"))
    message = F.to_json(F.struct(F.col("asset_nk").alias("serialNumber"), "model", "oem", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("effectiveAt")))
    return rows.select(message.alias("equipment_data"), F.col("arrived").alias("ingestion_timestamp"))


def calendar_of(wh: Warehouse, fact: str, day: str) -> DataFrame:
    """Calendar rows of the days a fact refers to."""
    return calendar_labels(wh[fact].select(F.col(day).alias("full_date")).distinct())


def messages(conversations: DataFrame) -> DataFrame:
    """Messages with a clock and a backend worked out from the conversation number and the text length."""
    n = "length(text)"
    return conversations.selectExpr(
        "conv_id AS conversation_id", "turn", "concat(conv_id, '-', turn) AS message_id",
        "timestampadd(SECOND, cast(turn * 37 AS int), timestampadd(HOUR, cast(conv_id % 100000 AS int), "
        "TIMESTAMP_NTZ'2024-01-01 00:00:00')) AS timestamp", "role", "text AS content",
        f"CASE WHEN role = 'assistant' THEN CASE WHEN {n} % 2 = 0 THEN 'agent' ELSE 'analyst' END END AS backend_used",
        f"CASE WHEN role = 'assistant' THEN cast({n} % 5 * 100 AS bigint) END AS response_time_ms")


def feedback(labels: DataFrame) -> DataFrame:
    """Quality labels as ratings of the documents."""
    return labels.selectExpr("doc_id AS message_id",
                             "CASE WHEN quality = 1 AND toxic = 0 THEN 'positive' ELSE 'negative' END AS rating")


def message_feedback(conversations: DataFrame) -> DataFrame:
    """Ratings of assistant messages; every fourth is rated twice, the second time an hour later and negative."""
    return conversations.filter("role = 'assistant'").selectExpr(
        "concat(conv_id, '-', turn) AS message_id", "concat('user', conv_id % 7) AS user_id",
        "explode(CASE WHEN conv_id % 4 = 1 THEN array(0, 1) ELSE array(0) END) AS i", "conv_id", "turn").selectExpr(
        "message_id", "user_id", "CASE WHEN i = 1 OR turn % 3 = 0 THEN 'negative' ELSE 'positive' END AS rating",
        "timestampadd(HOUR, i, timestampadd(HOUR, cast(conv_id % 100000 AS int), TIMESTAMP_NTZ'2024-01-02 00:00:00')) AS timestamp")


def bind_sample(spark: SparkSession, sf_dir: str) -> Warehouse:
    """The sample tables of ``sf_dir`` as a :class:`Warehouse`."""
    def of(table: str, project) -> object:
        return lambda wh: project(_sample(spark, sf_dir, table))

    tables = {
        "raw_telemetry": of("events", raw_telemetry),
        "raw_maintenance": raw_maintenance,
        "raw_equipment": raw_equipment,
        "raw_equipment_feed": raw_equipment_feed,
        "dim_plant": of("region", plant),
        "dim_line": of("nation", line),
        "dim_process": of("nation", process),
        "dim_asset_class": lambda wh: asset_class(spark),
        "dim_asset": of("customer", asset),
        "dim_asset_versions": lambda wh: asset_versions(wh["dim_asset"]),
        "dim_machine": of("supplier", machine),
        "dim_sensor": lambda wh: sensor(wh["dim_asset"]),
        "dim_technician": of("supplier", technician),
        "dim_material": of("part", material),
        "dim_work_order_type": lambda wh: work_order_types(spark),
        "dim_failure_code": lambda wh: failure_codes(spark),
        "dim_date": lambda wh: calendar_of(wh, "fct_maintenance_log", "completed_date"),
        "fct_asset_telemetry": of("events", telemetry),
        "fct_service_log": of("events", service_log),
        "fct_maintenance_log": of("orders", maintenance),
        "fct_production_log": of("lineitem", production),
        "fct_maintenance_parts_used": of("lineitem", parts_used),
        "fct_budget": budget,
        "agg_asset_hourly_health": lambda wh: hourly_health(wh["fct_asset_telemetry"]),
        "agg_asset_latest_health": latest_hours,
        "ml_feature_store": feature_store,
        "conversation_history": of("conversations", messages),
        "documents": of("documents", lambda df: df),
        "feedback": of("labels", feedback),
        "message_feedback": of("conversations", message_feedback),
    }
    time_columns = {
        **TIME_COLUMNS,
        "fct_production_log": (("production_date", "date"), ("source_ts", "ntz")),
        "fct_maintenance_log": (("completed_date", "date"), ("source_ts", "ntz")),
    }
    return Warehouse(spark, tables, time_columns)
