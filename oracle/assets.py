"""Asset health, risk, telemetry, tools."""

from __future__ import annotations

from oracle.prelude import TELEMETRY_NOW, r

_H = ("CAST(latest_health_score AS DOUBLE) AS latest_health_score, "
      "CAST(avg_failure_probability AS DOUBLE) AS avg_failure_probability")
_RISK = """, risk AS (SELECT a.asset_id, a.asset_name, a.class_name, a.downtime_impact_per_hour, a.plant_name, a.model,
    l.hour_timestamp, l.avg_failure_probability, l.latest_health_score, l.min_rul_days,
    l.avg_failure_probability * a.downtime_impact_per_hour * 24 AS production_at_risk
    FROM latest l JOIN placed a USING (asset_id))"""
_RISK_COLUMNS = f"""asset_id, asset_name, class_name, CAST(downtime_impact_per_hour AS DOUBLE) AS downtime_impact_per_hour,
    {_H}, min_rul_days, CAST(production_at_risk AS DOUBLE) AS production_at_risk"""
_PRED = "CASE WHEN avg_failure_probability > 0.8 THEN 'critical' WHEN avg_failure_probability > 0.6 THEN 'high' ELSE 'medium' END"
_LONG = """, long AS (SELECT telemetry_id, asset_id, recorded_at, 'Temperature' AS sensor_type, CAST(temperature_c AS DOUBLE) AS value,
      0 AS k FROM telemetry WHERE temperature_c IS NOT NULL
    UNION ALL SELECT telemetry_id, asset_id, recorded_at, 'Vibration', CAST(vibration_mm_s AS DOUBLE), 1 FROM telemetry
      WHERE vibration_mm_s IS NOT NULL
    UNION ALL SELECT telemetry_id, asset_id, recorded_at, 'Pressure', CAST(pressure_psi AS DOUBLE), 2 FROM telemetry
      WHERE pressure_psi IS NOT NULL)"""
_STATUS = """CASE WHEN sensor_type = 'Temperature' THEN CASE WHEN value > 150 THEN 'critical' WHEN value > 100 THEN 'warning' ELSE 'normal' END
    WHEN sensor_type = 'Vibration' THEN CASE WHEN value > 2.0 THEN 'critical' WHEN value > 1.5 THEN 'warning' ELSE 'normal' END
    ELSE CASE WHEN value > 160 OR value < 120 THEN 'warning' ELSE 'normal' END END"""
_LATEST_TELEMETRY = """SELECT asset_id, CAST(arg_max(temperature_c, recorded_at) FILTER (temperature_c IS NOT NULL) AS DOUBLE) AS temperature_c,
    CAST(arg_max(vibration_mm_s, recorded_at) FILTER (vibration_mm_s IS NOT NULL) AS DOUBLE) AS vibration_mm_s,
    CAST(arg_max(pressure_psi, recorded_at) FILTER (pressure_psi IS NOT NULL) AS DOUBLE) AS pressure_psi
    FROM telemetry GROUP BY 1"""
_LAST_ROW = "SELECT * FROM telemetry QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY recorded_at DESC, telemetry_id DESC) = 1"


def _prediction(source: str, where: str) -> str:
    return f""", top AS (SELECT h.*, a.asset_name, a.model, a.downtime_impact_per_hour FROM {source} h JOIN asset a USING (asset_id)
        WHERE {where} ORDER BY avg_failure_probability DESC, asset_id, hour_timestamp LIMIT 10)
      SELECT asset_id, hour_timestamp, asset_name, model, CAST(avg_failure_probability AS DOUBLE) AS avg_failure_probability,
        min_rul_days, CAST(downtime_impact_per_hour AS DOUBLE) AS downtime_impact_per_hour, {_PRED} AS risk_level,
        CAST((SELECT sum(avg_failure_probability * downtime_impact_per_hour) FROM top) AS DOUBLE) AS total_risk_value FROM top"""


def _downtime(source: str) -> str:
    return f""", top AS (SELECT h.*, a.asset_name, a.downtime_impact_per_hour,
          avg_failure_probability * downtime_impact_per_hour * 24 AS daily FROM {source} h JOIN asset a USING (asset_id)
        WHERE min_rul_days <= 30 ORDER BY daily DESC, asset_id, hour_timestamp LIMIT 10)
      SELECT asset_id, hour_timestamp, asset_name, CAST(downtime_impact_per_hour AS DOUBLE) AS downtime_impact_per_hour,
        CAST(avg_failure_probability AS DOUBLE) AS avg_failure_probability, min_rul_days, CAST(daily AS DOUBLE) AS daily_risk_value,
        CAST(daily * 30 AS DOUBLE) AS period_risk, CAST((SELECT sum(daily * 30) FROM top) AS DOUBLE) AS portfolio_risk FROM top"""


def _health(source: str) -> str:
    return f"""SELECT asset_id, hour_timestamp, asset_name, model, oem_name, {_H},
        CAST(downtime_impact_per_hour AS DOUBLE) AS downtime_impact_per_hour,
        CASE WHEN latest_health_score >= 90 THEN 'healthy' WHEN latest_health_score >= 70 THEN 'warning' ELSE 'critical' END AS status
      FROM {source} JOIN asset USING (asset_id)
      ORDER BY hourly_probability DESC, asset_id, hour_timestamp LIMIT 10""".replace(
          "hourly_probability", f"{source}.avg_failure_probability")


_DAILY_HEALTH = f"""SELECT CAST(hour_timestamp AS DATE) AS health_date,
      {r("CAST(sum(latest_health_score) AS DOUBLE) / count(latest_health_score)", 4)} AS avg_health_score FROM hourly
      WHERE hour_timestamp BETWEEN {TELEMETRY_NOW} - INTERVAL 30 DAY AND {TELEMETRY_NOW} GROUP BY 1"""

SQL: dict[str, str] = {
    "latest_health": f"SELECT asset_id, hour_timestamp, {_H}, min_rul_days FROM latest",
    "health_daily": _DAILY_HEALTH,
    "kpi_health_delta": f""", d AS ({_DAILY_HEALTH}), n AS (SELECT *, row_number() OVER (ORDER BY health_date DESC) AS k FROM d),
      p AS (SELECT CASE WHEN count(*) >= 8 THEN avg(CASE WHEN k BETWEEN 2 AND 8 THEN avg_health_score END) END AS pri FROM n),
      c AS (SELECT {r("CAST(sum(latest_health_score) AS DOUBLE) / count(latest_health_score)", 4)} AS cur FROM latest),
      x AS (SELECT cur AS current_health, {r("coalesce(pri, cur)", 4)} AS prior_week_health FROM c, p)
      SELECT *, {r("current_health - prior_week_health", 4)} AS health_delta FROM x""",
    "asset_risk_latest": f"{_RISK} SELECT {_RISK_COLUMNS} FROM risk",
    "production_at_risk": f"""{_RISK} SELECT CAST(sum(production_at_risk) AS DOUBLE) AS production_at_risk, count(*) AS assets FROM risk""",
    "risk_by_class": f"{_RISK} SELECT class_name, CAST(sum(production_at_risk) AS DOUBLE) AS production_at_risk FROM risk GROUP BY 1",
    "risk_matrix": f"{_RISK} SELECT {_RISK_COLUMNS} FROM risk WHERE class_name = 'MACHINERY'",
    "highest_risk_asset": f"""{_RISK} SELECT class_name, CAST(production_at_risk AS DOUBLE) AS production_at_risk, asset_id,
      asset_name, min_rul_days, CAST(avg_failure_probability AS DOUBLE) AS avg_failure_probability FROM risk
      QUALIFY row_number() OVER (PARTITION BY class_name ORDER BY risk.production_at_risk DESC, asset_id) = 1""",
    "asset_hierarchy": "SELECT asset_id, asset_name, model, oem_name, class_name, process_name, line_name, plant_name FROM placed",
    "asset_details": f"""SELECT a.asset_id, asset_name, model, oem_name, installation_date,
      CAST(downtime_impact_per_hour AS DOUBLE) AS downtime_impact_per_hour, class_name, process_name, line_name, plant_name, {_H},
      min_rul_days, CASE WHEN latest_health_score >= 90 THEN 'excellent' WHEN latest_health_score >= 75 THEN 'attention'
        WHEN latest_health_score IS NOT NULL THEN 'immediate' END AS health_band FROM placed a LEFT JOIN latest l USING (asset_id)""",
    "asset_health_snapshot": _health("latest"),
    "asset_health_hourly": _health("hourly"),
    "failure_prediction_hourly": _prediction("hourly", "avg_failure_probability > 0.5 AND min_rul_days <= 30"),
    "failure_prediction_snapshot": _prediction("latest", "avg_failure_probability > 0.1 AND min_rul_days <= 30"),
    "downtime_risk_hourly": _downtime("hourly"),
    "downtime_risk_snapshot": _downtime("latest"),
    "triage": f"""{_RISK} SELECT asset_id, class_name, CAST(latest_health_score AS DOUBLE) AS latest_health_score, min_rul_days
      FROM risk WHERE latest_health_score <= 85 AND class_name IN ('MACHINERY', 'BUILDING', 'FURNITURE')""",
    "work_order_candidates": f"""{_RISK} SELECT 'WO-20240130-' || asset_id AS work_order_id, asset_id, asset_name,
      CASE WHEN avg_failure_probability > 0.8 THEN 'Critical' WHEN avg_failure_probability > 0.6 THEN 'High' ELSE 'Medium' END AS priority,
      CASE WHEN min_rul_days <= 7 THEN 'Emergency Repair' ELSE 'Preventive Maintenance' END AS work_type
      FROM risk WHERE avg_failure_probability > 0.1 AND min_rul_days <= 30""",
    "pm_schedule": """SELECT DISTINCT 'PM-20240201-' || a.asset_id AS schedule_id, a.asset_id, asset_name
      FROM asset a WHERE a.asset_id IN (SELECT asset_id FROM service WHERE wo_type_id = 1)""",
    "alerts": f"""{_RISK}, c AS (SELECT plant_name, asset_id, row_number() OVER (PARTITION BY plant_name ORDER BY asset_id) AS k
        FROM risk WHERE latest_health_score < 85)
      SELECT plant_name, count(*) AS critical_assets, string_agg(asset_id, ',' ORDER BY asset_id) FILTER (k <= 5) AS first_assets
      FROM c GROUP BY 1""",
    "plants": "SELECT DISTINCT plant_name FROM plant",
    "lines": "SELECT DISTINCT line_name FROM line JOIN plant USING (plant_id) WHERE plant_name = 'ASIA'",
    "line_assets": "SELECT DISTINCT line_name, process_id, process_name, asset_id, asset_name FROM placed WHERE line_name = 'NATION_7'",
    "telemetry_pivot": f"""SELECT asset_id, date_trunc('hour', recorded_at) AS hour_timestamp,
      {r("CAST(sum(temperature_c) AS DOUBLE) / nullif(count(temperature_c), 0)")} AS temperature_c,
      {r("CAST(sum(vibration_mm_s) AS DOUBLE) / nullif(count(vibration_mm_s), 0)")} AS vibration_mm_s,
      {r("CAST(sum(pressure_psi) AS DOUBLE) / nullif(count(pressure_psi), 0)")} AS pressure_psi FROM telemetry GROUP BY 1, 2""",
    "latest_telemetry": _LATEST_TELEMETRY,
    "latest_prediction": f""", x AS ({_LAST_ROW}) SELECT asset_id, recorded_at, CAST(health_score AS DOUBLE) AS health_score,
      CAST(failure_probability AS DOUBLE) AS failure_probability, rul_days, is_anomalous FROM x""",
    "sensor_status": f""", t AS ({_LATEST_TELEMETRY}), u AS (SELECT asset_id, 'Temperature' AS sensor_type, temperature_c AS value FROM t
        UNION ALL SELECT asset_id, 'Vibration', vibration_mm_s FROM t UNION ALL SELECT asset_id, 'Pressure', pressure_psi FROM t)
      SELECT asset_id, sensor_type, value, {_STATUS} AS status FROM u WHERE value IS NOT NULL""",
    "asset_status": f""", x AS ({_LAST_ROW}), y AS (SELECT a.asset_id, downtime_impact_per_hour, failure_probability, x.rul_days, is_anomalous,
        coalesce(CAST(health_score AS DOUBLE) / 100, 0.8e0) AS h FROM asset a LEFT JOIN x USING (asset_id))
      SELECT asset_id, {r("h", 4)} AS health_score01, CASE WHEN coalesce(is_anomalous, false) OR h < 0.5 THEN 'Critical'
        WHEN h < 0.7 THEN 'Warning' ELSE 'Online' END AS status,
        CASE WHEN h > 0.8 THEN 'green' WHEN h > 0.5 THEN 'yellow' ELSE 'red' END AS colour,
        printf('%.1f%%', coalesce(CAST(failure_probability AS DOUBLE), 0.05e0) * 100) AS failure_text,
        '$' || format('{{:,.0f}}', CAST(downtime_impact_per_hour AS DOUBLE)) || '/hr' AS cost_text,
        coalesce(rul_days, 180) AS rul_days FROM y""",
    "rule_scores": f""", x AS (SELECT telemetry_id, date_diff('day', DATE '2023-09-01', d) AS days,
        {r("greatest(70e0, least(100e0, 100e0 - date_diff('day', DATE '2023-09-01', d) * 0.15e0 - hour(recorded_at) * 0.1e0 - coalesce(CAST(temperature_c AS DOUBLE) / 100e0, 0e0)))")} AS h FROM telemetry)
      SELECT telemetry_id, h AS rule_health, {r("least(0.95e0, greatest(0.01e0, (100e0 - h) / 400e0))")} AS rule_probability,
        greatest(1, CAST(floor(400e0 - days * 0.8e0 + 0.5e0) AS INTEGER)) AS rule_rul_days FROM x""",
    "anomaly_flags": """SELECT telemetry_id, asset_id, recorded_at, CAST(health_score AS DOUBLE) AS health_score,
      CAST(vibration_mm_s AS DOUBLE) AS vibration_mm_s, class_name = 'MACHINERY' AS rotating FROM telemetry JOIN placed USING (asset_id)
      WHERE health_score < 80 OR (class_name = 'MACHINERY' AND vibration_mm_s > 1.2)""",
    "sensor_readings": """, s AS (SELECT a.asset_id, a.asset_id * 3 + k AS sensor_sk,
        a.asset_nk || '_' || lower(t) AS sensor_nk, t AS sensor_type, u AS units_of_measure
        FROM asset a, (VALUES (0, 'Temperature', 'Celsius'), (1, 'Vibration', 'mm/s'), (2, 'Pressure', 'PSI')) v(k, t, u))
      SELECT sensor_sk, sensor_nk, sensor_type, units_of_measure, recorded_at, CAST(temperature_c AS DOUBLE) AS temperature_c,
        CAST(vibration_mm_s AS DOUBLE) AS vibration_mm_s, CAST(pressure_psi AS DOUBLE) AS pressure_psi,
        CAST(health_score AS DOUBLE) AS health_score, CAST(failure_probability AS DOUBLE) AS failure_probability, rul_days, is_anomalous
      FROM s JOIN telemetry USING (asset_id) WHERE asset_id = 7
        AND recorded_at BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-25'""",
    "sensor_readings_by_metric": f"""{_LONG} SELECT asset_id * 3 + k AS sensor_sk, telemetry_id, recorded_at, sensor_type, value FROM long
      WHERE recorded_at BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-25'""",
    "latest_reading_per_sensor": f"""{_LONG} SELECT asset_id * 3 + k AS sensor_sk, sensor_type, recorded_at, value FROM long
      QUALIFY row_number() OVER (PARTITION BY asset_id, k ORDER BY recorded_at DESC) = 1""",
    "out_of_range": f"""{_LONG}, s AS (SELECT asset_id * 3 + k AS sensor_sk, sensor_type, {_STATUS} AS status FROM long
        WHERE recorded_at BETWEEN {TELEMETRY_NOW} - INTERVAL 24 HOUR AND {TELEMETRY_NOW})
      SELECT sensor_sk, sensor_type, count(*) AS readings, count(*) FILTER (status = 'critical') AS critical_readings
      FROM s WHERE status <> 'normal' GROUP BY 1, 2""",
    "hot_sensors": f"""{_LONG} SELECT count(DISTINCT asset_id) AS sensors FROM long WHERE sensor_type = 'Temperature' AND value > 70
      AND recorded_at BETWEEN {TELEMETRY_NOW} - INTERVAL 168 HOUR AND {TELEMETRY_NOW}""",
    "anomaly_sessions": """, t AS (SELECT asset_id, recorded_at, lag(recorded_at) OVER w AS p FROM telemetry WHERE is_anomalous
        WINDOW w AS (PARTITION BY asset_id ORDER BY recorded_at)),
      u AS (SELECT *, sum(CASE WHEN p IS NULL OR recorded_at - p > INTERVAL 720 MINUTE THEN 1 ELSE 0 END)
        OVER (PARTITION BY asset_id ORDER BY recorded_at) AS s FROM t)
      SELECT asset_id, min(recorded_at) AS session_start, max(recorded_at) AS last_reading, count(*) AS readings
      FROM u GROUP BY asset_id, s""",
    "scd2_point_in_time": """, v AS (SELECT asset_id, 1 AS version, CAST(downtime_impact_per_hour * 0.8 AS DECIMAL(14,3)) AS impact,
          TIMESTAMP '2015-01-01' AS f, TIMESTAMP '2024-01-01' + to_days(CAST(asset_id % 30 AS INTEGER)) AS t FROM asset
        UNION ALL SELECT asset_id, 2, CAST(downtime_impact_per_hour AS DECIMAL(14,3)),
          TIMESTAMP '2024-01-01' + to_days(CAST(asset_id % 30 AS INTEGER)), NULL FROM asset)
      SELECT version = 2 AS is_current, d AS reading_date, count(*) AS readings, CAST(sum(failure_probability * impact) AS DOUBLE) AS risk_value
      FROM telemetry JOIN v ON v.asset_id = telemetry.asset_id AND f <= recorded_at AND (t IS NULL OR recorded_at < t) GROUP BY 1, 2""",
    "flow_edges": """, x AS (SELECT process_id, asset_id, lead(asset_id) OVER (PARTITION BY process_id
        ORDER BY process_sequence, asset_id) AS next_asset_id FROM asset) SELECT * FROM x WHERE next_asset_id IS NOT NULL""",
    "process_edges": """, x AS (SELECT line_id, process_id, lead(process_id) OVER (PARTITION BY line_id ORDER BY process_id)
        AS next_process_id FROM process) SELECT * FROM x WHERE next_process_id IS NOT NULL""",
    "path_levels": """SELECT split_part(asset_path, '/', 2) AS line_key, split_part(asset_path, '/', 3) AS process_key,
      count(*) AS assets, max(split_part(asset_path, '/', 4)) AS last_asset FROM asset GROUP BY 1, 2""",
    "hot_sensors_compared": f"""{_LONG} SELECT count(DISTINCT asset_id) AS sensors, TRUE AS sketch_is_close FROM long
      WHERE sensor_type = 'Temperature' AND value > 70 AND recorded_at BETWEEN {TELEMETRY_NOW} - INTERVAL 168 HOUR AND {TELEMETRY_NOW}""",
    "factory_tree_back": f""", t AS ({_LATEST_TELEMETRY}) SELECT plant_name, line_name, 'proc_' || process_id AS process, 'asset_' || asset_id AS asset,
      asset_name, CAST((temperature_c IS NOT NULL)::INT + (vibration_mm_s IS NOT NULL)::INT + (pressure_psi IS NOT NULL)::INT AS BIGINT) AS sensors,
      TRUE AS intact FROM placed LEFT JOIN t USING (asset_id)""",
    "tree_counts": f""", t AS ({_LATEST_TELEMETRY}) SELECT plant_name, line_name, process_name, count(*) AS assets,
      CAST(sum((temperature_c IS NOT NULL)::INT + (vibration_mm_s IS NOT NULL)::INT + (pressure_psi IS NOT NULL)::INT) AS BIGINT) AS sensors
      FROM placed LEFT JOIN t USING (asset_id) GROUP BY 1, 2, 3""",
}
