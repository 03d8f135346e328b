"""Gold tables in the literal form: range joins per feature."""

from __future__ import annotations

from oracle.prelude import r

_SK = "CAST(strftime({d}, '%Y%m%d') AS INTEGER)"
_OBS = f""", obs AS (SELECT DISTINCT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS observation_date_sk, asset_id, d FROM telemetry)"""
_TEMP = f"""SELECT o.observation_date_sk, o.asset_id,
    {r("CAST(sum(t.temperature_c) AS DOUBLE) / nullif(count(t.temperature_c), 0)")} AS avg_temp_last_24h
    FROM obs o JOIN telemetry t ON o.asset_id = t.asset_id AND t.recorded_at >= CAST(o.d AS TIMESTAMP) - INTERVAL 24 HOUR
      AND t.recorded_at < CAST(o.d AS TIMESTAMP) + INTERVAL 1 DAY GROUP BY 1, 2"""
_VIB = f"""SELECT o.observation_date_sk, o.asset_id, {r("stddev_samp(t.vibration_mm_s)")} AS vibration_stddev_7d
    FROM obs o JOIN telemetry t ON o.asset_id = t.asset_id AND t.recorded_at >= CAST(o.d AS TIMESTAMP) - INTERVAL 7 DAY
      AND t.recorded_at < CAST(o.d AS TIMESTAMP) + INTERVAL 1 DAY GROUP BY 1, 2"""
_PSI = f"""SELECT o.observation_date_sk, o.asset_id,
    {r("CAST(max(t.pressure_psi) - min(t.pressure_psi) AS DOUBLE) / nullif(count(t.pressure_psi), 0)")} AS pressure_trend_7d
    FROM obs o LEFT JOIN telemetry t ON o.asset_id = t.asset_id AND t.recorded_at >= CAST(o.d AS TIMESTAMP) - INTERVAL 7 DAY
      AND t.recorded_at < CAST(o.d AS TIMESTAMP) + INTERVAL 1 DAY AND t.pressure_psi IS NOT NULL GROUP BY 1, 2"""
_SINCE = """SELECT o.observation_date_sk, o.asset_id,
    CAST(coalesce(date_diff('day', max(CASE WHEN s.wo_type_id = 3 THEN s.completed_date END), o.d), 999) AS INTEGER) AS days_since_last_pm,
    CAST(coalesce(date_diff('day', max(CASE WHEN s.failure_flag THEN s.completed_date END), o.d), 999) AS INTEGER) AS days_since_last_failure
    FROM obs o LEFT JOIN service s ON o.asset_id = s.asset_id AND s.completed_date < o.d GROUP BY o.observation_date_sk, o.asset_id, o.d"""
_LABEL = """SELECT o.observation_date_sk, o.asset_id,
    bool_or(coalesce(s.failure_flag AND s.completed_date > o.d AND s.completed_date <= o.d + 7, false)) AS failed_in_next_7_days
    FROM obs o LEFT JOIN service s ON o.asset_id = s.asset_id GROUP BY 1, 2"""
_RATE = f""", seen AS (SELECT DISTINCT asset_id, d FROM telemetry), bad AS (SELECT DISTINCT asset_id, completed_date AS d FROM service WHERE failure_flag),
  days AS (SELECT oem_name, d FROM seen JOIN asset USING (asset_id) UNION SELECT oem_name, d FROM bad JOIN asset USING (asset_id)),
  rate AS (SELECT q.oem_name, q.d, {r('''CAST((SELECT count(*) FROM bad b JOIN asset a USING (asset_id) WHERE a.oem_name = q.oem_name AND b.d < q.d) AS DOUBLE)
    / nullif((SELECT count(*) FROM seen b JOIN asset a USING (asset_id) WHERE a.oem_name = q.oem_name AND b.d < q.d), 0)''', 4)} AS oem_failure_rate_est
    FROM days q)"""
_STORE = f"""{_OBS}, tf AS ({_TEMP}), vf AS ({_VIB}), pf AS ({_PSI}), mf AS ({_SINCE}), ff AS ({_LABEL}){_RATE},
  dh AS (SELECT asset_id, d, max(health_score) AS h FROM telemetry GROUP BY 1, 2),
  store AS (SELECT o.observation_date_sk, o.asset_id, avg_temp_last_24h, vibration_stddev_7d, pressure_trend_7d,
    greatest(0, days_since_last_pm * 24 * 50) AS cycles_since_last_pm, days_since_last_failure, oem_failure_rate_est,
    {r("(100 - coalesce(h, 95)) * downtime_impact_per_hour")} AS downtime_impact_risk, failed_in_next_7_days
    FROM obs o LEFT JOIN tf USING (observation_date_sk, asset_id) LEFT JOIN vf USING (observation_date_sk, asset_id)
    LEFT JOIN pf USING (observation_date_sk, asset_id) LEFT JOIN mf USING (observation_date_sk, asset_id)
    LEFT JOIN ff USING (observation_date_sk, asset_id) LEFT JOIN asset a ON a.asset_id = o.asset_id
    LEFT JOIN dh ON dh.asset_id = o.asset_id AND dh.d = o.d LEFT JOIN rate ON rate.oem_name = a.oem_name AND rate.d = o.d)"""
STORE = _STORE
OBS = _OBS
LABEL = _LABEL
_REASON = """CASE WHEN event_id % 97 = 5 THEN 'not json' WHEN event_id % 83 = 9 THEN 'missing deviceId'
    WHEN event_id % 89 = 7 THEN 'wrong type value' END"""

_DEVICE = "CASE WHEN event_id % 71 = 3 THEN 'old_' ELSE 'eq_' END || user_id"
_VERSIONS = """, m AS (SELECT 'eq_' || asset_id AS serial_number, k,
    CASE WHEN k = 3 AND asset_id % 4 = 0 THEN 'Model new' WHEN k = 4 AND asset_id % 5 = 0 THEN 'Model corrected' ELSE model END AS model,
    CASE WHEN k IN (2, 3, 4) AND asset_id % 3 = 0 AND NOT (k = 4 AND asset_id % 5 = 0) THEN 'OEM next' ELSE oem_name END AS oem_name,
    TIMESTAMP '2023-01-01 00:00:00' + INTERVAL 1 DAY * CAST(asset_id % 20 + CASE WHEN k = 4 AND asset_id % 5 = 0 THEN 90 WHEN k = 4 THEN 120 ELSE 60 * k END AS INTEGER) AS since
    FROM asset, range(5) t(k)),
  o AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY serial_number, since ORDER BY k DESC) = 1),
  c AS (SELECT * FROM o QUALIFY lag((model, oem_name)) OVER (PARTITION BY serial_number ORDER BY since) IS DISTINCT FROM (model, oem_name))
  SELECT serial_number, model, oem_name, since AS scd_start_date, lead(since) OVER w AS scd_end_date, lead(since) OVER w IS NULL AS is_current
  FROM c WINDOW w AS (PARTITION BY serial_number ORDER BY since)"""

SQL: dict[str, str] = {
    "asset_versions_built": _VERSIONS,
    "asset_versions_merged": _VERSIONS,
    "variant_values": """SELECT event_id, CASE WHEN event_id % 83 <> 9 THEN CASE WHEN event_id % 71 = 3 THEN 'old_' ELSE 'eq_' END || user_id END AS device_id,
      CASE WHEN event_id % 89 <> 7 THEN value END AS value, event_type AS metric FROM events WHERE event_id % 97 <> 5""",
    "temperature_before_hours": f"""SELECT asset_id, e AS hour_end, {r("CAST(sum(temperature_c) AS DOUBLE) / count(temperature_c)")} AS avg_temperature_c,
      count(temperature_c) AS readings FROM (SELECT DISTINCT asset_id, date_trunc('hour', recorded_at) + INTERVAL 1 HOUR AS e FROM telemetry) h
      JOIN telemetry t USING (asset_id) WHERE temperature_c IS NOT NULL AND recorded_at >= e - INTERVAL 24 HOUR AND recorded_at < e GROUP BY 1, 2""",
    "sketches_compared": """SELECT a AS first_day, b AS last_day, s AS sensor_type, count(DISTINCT asset_id) AS exact, TRUE AS within_3_percent
      FROM (VALUES ('2024-01-01', '2024-01-31'), ('2024-01-05', '2024-01-11'), ('2024-01-20', '2024-01-20')) v(a, b)
      JOIN (SELECT asset_id, d, 'Temperature' AS s FROM telemetry WHERE temperature_c IS NOT NULL UNION ALL
            SELECT asset_id, d, 'Vibration' FROM telemetry WHERE vibration_mm_s IS NOT NULL UNION ALL
            SELECT asset_id, d, 'Pressure' FROM telemetry WHERE pressure_psi IS NOT NULL) x ON d BETWEEN CAST(a AS DATE) AND CAST(b AS DATE) GROUP BY 1, 2, 3""",
    "repeated_positions": "SELECT asset_id, CAST(unnest(range(1, process_sequence + 1)) AS INTEGER) AS step FROM asset",
    "star_join_production": """SELECT plant_name, process_type, sum(produced)::BIGINT AS units_produced, sum(scrapped)::BIGINT AS units_scrapped
      FROM production JOIN machine_placed USING (asset_id) GROUP BY 1, 2""",
    "star_join_telemetry": """SELECT line_name, class_name, count(*) AS readings, count(*) FILTER (is_anomalous) AS anomalous
      FROM telemetry LEFT JOIN placed USING (asset_id) GROUP BY 1, 2""",
    "star_join_parts": """SELECT plant_name, supplier_name, CAST(sum(total_cost) AS DOUBLE) AS parts_cost
      FROM parts LEFT JOIN maintenance USING (log_id) LEFT JOIN placed USING (asset_id) LEFT JOIN material USING (material_id) GROUP BY 1, 2""",
    "star_join_budget": """SELECT plant_name, CAST(year(completed_date) + 1 AS INTEGER) AS year, CAST(sum(parts_cost + labor_cost) AS DOUBLE) AS budget
      FROM maintenance JOIN placed USING (asset_id) GROUP BY 1, 2""",
    "line_months": """, a AS (SELECT line_name, CAST(date_trunc('month', completed_date) AS DATE) AS month, count(*) AS orders, CAST(sum(downtime_hours) AS DOUBLE) AS downtime_hours,
        count(*) FILTER (failure_flag) AS failures FROM maintenance LEFT JOIN placed USING (asset_id) GROUP BY 1, 2),
      b AS (SELECT line_name, CAST(date_trunc('month', production_date) AS DATE) AS month, sum(produced)::BIGINT AS units_produced, sum(scrapped)::BIGINT AS units_scrapped
        FROM production LEFT JOIN machine_placed USING (asset_id) GROUP BY 1, 2),
      c AS (SELECT line_name, CAST(date_trunc('month', d) AS DATE) AS month, count(*) AS readings, count(*) FILTER (is_anomalous) AS anomalous
        FROM telemetry LEFT JOIN placed USING (asset_id) GROUP BY 1, 2)
      SELECT * FROM a FULL JOIN b USING (line_name, month) FULL JOIN c USING (line_name, month)""",
    "hourly_health": """SELECT hour_timestamp, asset_id, avg_temperature_c, max_vibration_mm_s, stddev_pressure_psi,
      CAST(latest_health_score AS DOUBLE) AS latest_health_score, CAST(avg_failure_probability AS DOUBLE) AS avg_failure_probability,
      min_rul_days FROM hourly""",
    "hourly_latest_by_time": """SELECT asset_id, date_trunc('hour', recorded_at) AS hour_timestamp, recorded_at,
      CAST(health_score AS DOUBLE) AS health_score FROM telemetry
      QUALIFY row_number() OVER (PARTITION BY asset_id, date_trunc('hour', recorded_at) ORDER BY recorded_at DESC, telemetry_id DESC) = 1""",
    "daily_observations": f"{_OBS} SELECT observation_date_sk, asset_id, d AS observation_date FROM obs",
    "feature_temp_24h": f"{_OBS} {_TEMP}",
    "feature_vibration_7d": f"{_OBS} {_VIB}",
    "feature_pressure_trend": f"{_OBS} {_PSI}",
    "feature_days_since": f"{_OBS} {_SINCE}",
    "label_next_7d": f"{_OBS} {_LABEL}",
    "feature_store": f"{_STORE} SELECT * FROM store",
    "feature_store_loaded": f"{_STORE} SELECT * FROM store",
    "latest_health_merged": """SELECT asset_id, hour_timestamp, CAST(latest_health_score AS DOUBLE) AS latest_health_score,
      CAST(avg_failure_probability AS DOUBLE) AS avg_failure_probability, min_rul_days FROM latest""",
    "bronze_parse": f"""SELECT event_id, ts AS source_timestamp, {_DEVICE} AS device_id, event_type AS metric, value,
      'x' AS unit FROM events WHERE {_REASON} IS NULL""",
    "bronze_rejects": f"SELECT event_id, {_REASON} AS reject_reason FROM events WHERE {_REASON} IS NOT NULL",
    "bronze_maintenance": """SELECT 'WO-' || log_id AS work_order_id, 'eq_' || asset_id AS asset_nk, wo_type_code, technician_notes AS notes,
      CAST(downtime_hours AS DOUBLE) AS downtime_hours, CAST(labor_cost AS DOUBLE) AS labor_cost, CAST(parts_cost AS DOUBLE) AS parts_cost,
      failure_flag, completed_date FROM maintenance JOIN wo_type USING (wo_type_id) WHERE log_id % 61 <> 7 AND log_id % 53 <> 9""",
    "maintenance_rejects": """SELECT CASE WHEN log_id % 61 = 7 THEN 'not json' ELSE 'missing date' END AS reject_reason, count(*) AS messages
      FROM maintenance WHERE log_id % 61 = 7 OR log_id % 53 = 9 GROUP BY 1""",
    "equipment_rejects": "SELECT 'missing serialNumber' AS reject_reason, count(*) AS messages FROM asset WHERE asset_id % 41 = 5",
    "variant_fields": """SELECT 'value' AS field, count(*) AS messages, 'DECIMAL,STRING' AS types FROM events WHERE event_id % 97 <> 5
      UNION ALL SELECT 'metric', count(*), 'STRING' FROM events WHERE event_id % 97 <> 5
      UNION ALL SELECT 'unit', count(*), 'STRING' FROM events WHERE event_id % 97 <> 5
      UNION ALL SELECT 'deviceId', count(*), 'STRING' FROM events WHERE event_id % 97 <> 5 AND event_id % 83 <> 9""",
    "ingestion_stamps": "SELECT count(*) AS messages, count(*) AS stamped FROM events",
    "written_days": """SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_sk, CASE WHEN d = DATE '2024-01-11' THEN count(*) FILTER (telemetry_id % 2 = 0) ELSE count(*) END AS readings,
      CAST(1 AS BIGINT) AS folders FROM telemetry WHERE d BETWEEN DATE '2024-01-10' AND DATE '2024-01-12' GROUP BY d""",
    "text_preview": "SELECT line_name AS value FROM line ORDER BY line_name LIMIT 5",
    "bronze_equipment": """SELECT asset_nk AS serial_number, model, oem_name, 'Machine' AS asset_type, 'Site' AS plant_name,
      installation_date FROM asset WHERE asset_id % 41 <> 5""",
    "bronze_to_wide": f""", x AS (SELECT {_DEVICE} AS device_id, date_trunc('hour', ts) AS hour_timestamp, event_type, value
        FROM events WHERE {_REASON} IS NULL)
      SELECT device_id, hour_timestamp, round(avg(value) FILTER (event_type = 'view'), 4) AS temperature_c,
        round(avg(value) FILTER (event_type = 'click'), 4) AS vibration_mm_s, round(avg(value) FILTER (event_type = 'signup'), 4) AS pressure_psi
      FROM x WHERE event_type IN ('view', 'click', 'signup') GROUP BY 1, 2""",
    "silver_readings": f"""SELECT asset_id, ts AS recorded_at, avg(value) FILTER (event_type = 'view') AS temperature_c,
        avg(value) FILTER (event_type = 'click') AS vibration_mm_s, avg(value) FILTER (event_type = 'signup') AS pressure_psi
      FROM events JOIN asset ON asset_nk = {_DEVICE} WHERE {_REASON} IS NULL AND event_type IN ('view', 'click', 'signup') GROUP BY 1, 2""",
    "unknown_devices": f"""SELECT {_DEVICE} AS device_id, count(*) AS messages FROM events
      WHERE {_REASON} IS NULL AND {_DEVICE} NOT IN (SELECT asset_nk FROM asset) GROUP BY 1""",
    "failure_score_facts": """, o AS (SELECT DISTINCT asset_id, d FROM telemetry WHERE d >= DATE '2024-01-20')
      SELECT EXISTS (SELECT 1 FROM service s WHERE s.asset_id = o.asset_id AND s.failure_flag AND s.completed_date BETWEEN o.d + 1 AND o.d + 7) AS failed_in_next_7_days,
        count(*) AS rows, TRUE AS scores_are_chances FROM o GROUP BY 1""",
    "date_dimension": """, s AS (SELECT unnest(generate_series(min(completed_date), max(completed_date), INTERVAL 1 DAY)) AS t FROM maintenance)
      SELECT CAST(strftime(t, '%Y%m%d') AS INTEGER) AS date_sk, CAST(t AS DATE) AS full_date, dayname(t) AS day_of_week,
        monthname(t) AS month_name, CAST(quarter(t) AS INTEGER) AS quarter, CAST(year(t) AS INTEGER) AS year FROM s""",
    "spine_gaps": """, b AS (SELECT asset_id, unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS t FROM telemetry GROUP BY 1)
      SELECT asset_id, CAST(t AS DATE) AS day FROM b WHERE NOT EXISTS (SELECT 1 FROM telemetry x WHERE x.asset_id = b.asset_id AND x.d = CAST(t AS DATE))""",
    "hour_gaps": """, h AS (SELECT DISTINCT asset_id, date_trunc('hour', recorded_at) AS t FROM telemetry),
      c AS (SELECT asset_id, date_diff('hour', min(t), max(t)) + 1 - count(*) AS missing_hours FROM h GROUP BY 1)
      SELECT * FROM c WHERE missing_hours > 0""",
    "dq_keys": "SELECT log_id, material_id, count(*) AS copies FROM parts GROUP BY 1, 2 HAVING count(*) > 1",
    "dq_orphans": """SELECT log_id AS orphan_key, count(*) AS child_rows, 'parts to order' AS reference FROM parts
        WHERE log_id NOT IN (SELECT log_id FROM maintenance) GROUP BY 1
      UNION ALL SELECT log_id, count(*), 'order to parts' FROM maintenance WHERE log_id NOT IN (SELECT log_id FROM parts) GROUP BY 1""",
    "dq_ranges": """SELECT count(*) AS rows_checked, 'health within 0 and 100' AS rule, count(*) FILTER (health_score < 0 OR health_score > 100) AS violations FROM telemetry
      UNION ALL SELECT count(*), 'probability within 0 and 1', count(*) FILTER (failure_probability < 0 OR failure_probability > 1) FROM telemetry
      UNION ALL SELECT count(*), 'health of 80 or more', count(*) FILTER (health_score < 80) FROM telemetry
      UNION ALL SELECT count(*), 'life of a day or more', count(*) FILTER (rul_days < 1) FROM telemetry
      UNION ALL SELECT count(*), 'runtime not negative', count(*) FILTER (actual < 0) FROM production
      UNION ALL SELECT count(*), 'runtime within plan', count(*) FILTER (actual > planned) FROM production
      UNION ALL SELECT count(*), 'scrap within output', count(*) FILTER (scrapped > produced) FROM production""",
    "dq_failure_codes": """SELECT count(*) AS rows_checked, 'code only on failures' AS rule, count(*) FILTER (failure_code_id IS NOT NULL AND NOT failure_flag) AS violations FROM maintenance
      UNION ALL SELECT count(*), 'every failure has a code', count(*) FILTER (failure_code_id IS NULL AND failure_flag) FROM maintenance
      UNION ALL SELECT count(*), 'known order type', count(*) FILTER (wo_type_id NOT IN (1, 2, 3, 4)) FROM maintenance""",
    "dq_parts_cost": """SELECT supplier_name, count(*) AS parts_rows, count(*) FILTER (total_cost <> quantity_used * unit_cost) AS mismatched_rows
      FROM parts JOIN material USING (material_id) GROUP BY 1""",
}


# Tables of the model as the sample gives them: rows with their key, then child keys and the keys they refer to.
_SENSOR = "SELECT asset_id * 3 + i AS k, asset_id FROM asset, range(3) t(i)"
_KEYS = {
    "dim_date": "SELECT DISTINCT completed_date AS k FROM maintenance", "dim_plant": "SELECT plant_id AS k FROM plant",
    "dim_line": "SELECT line_id AS k FROM line", "dim_process": "SELECT process_id AS k FROM process",
    "dim_asset_class": "SELECT asset_class_id AS k FROM asset_class", "dim_asset": "SELECT asset_id AS k FROM asset",
    "dim_work_order_type": "SELECT wo_type_id AS k FROM wo_type", "dim_sensor": f"SELECT k FROM ({_SENSOR})",
    "dim_technician": "SELECT technician_id AS k FROM technician", "dim_failure_code": "SELECT failure_code_id AS k FROM failure_code",
    "dim_material": "SELECT material_id AS k FROM material", "fct_asset_telemetry": "SELECT telemetry_id AS k FROM telemetry",
    "fct_maintenance_log": "SELECT log_id AS k FROM maintenance", "fct_maintenance_parts_used": "SELECT (log_id, material_id) AS k FROM parts",
    "agg_asset_hourly_health": "SELECT (asset_id, hour_timestamp) AS k FROM hourly",
    "agg_asset_latest_health": "SELECT asset_id AS k FROM latest",
    "ml_feature_store": "SELECT DISTINCT (asset_id, d) AS k FROM telemetry",
    "conversation_history": "SELECT (conv_id, turn) AS k FROM conversations"}
_PLANTS = "SELECT DISTINCT plant_id, year(completed_date), quarter(completed_date), wo_type_id <= 2 FROM maintenance JOIN placed USING (asset_id)"
_REFERENCES = {
    "dim_process.line_id": ("SELECT line_id AS k FROM process", "line", "line_id"),
    "dim_asset.process_id": ("SELECT process_id AS k FROM asset", "process", "process_id"),
    "dim_asset.asset_class_id": ("SELECT asset_class_id AS k FROM asset", "asset_class", "asset_class_id"),
    "dim_sensor.asset_id": (f"SELECT asset_id AS k FROM ({_SENSOR})", "asset", "asset_id"),
    "dim_line.plant_id": ("SELECT plant_id AS k FROM line", "plant", "plant_id"),
    "fct_asset_telemetry.asset_id": ("SELECT asset_id AS k FROM telemetry", "asset", "asset_id"),
    "fct_asset_telemetry.process_id": ("SELECT NULL AS k FROM telemetry", "process", "process_id"),
    "fct_asset_telemetry.date_sk": ("SELECT d AS k FROM telemetry", "maintenance", "completed_date"),
    "fct_maintenance_log.asset_id": ("SELECT asset_id AS k FROM maintenance", "asset", "asset_id"),
    "fct_maintenance_log.wo_type_id": ("SELECT wo_type_id AS k FROM maintenance", "wo_type", "wo_type_id"),
    "fct_maintenance_log.technician_id": ("SELECT technician_id AS k FROM maintenance", "technician", "technician_id"),
    "fct_maintenance_log.failure_code_id": ("SELECT failure_code_id AS k FROM maintenance", "failure_code", "failure_code_id"),
    "fct_maintenance_log.action_date_sk": ("SELECT completed_date AS k FROM maintenance", "maintenance", "completed_date"),
    "fct_maintenance_parts_used.log_id": ("SELECT log_id AS k FROM parts", "maintenance", "log_id"),
    "fct_maintenance_parts_used.material_id": ("SELECT material_id AS k FROM parts", "material", "material_id"),
    "fct_production_log.asset_id": ("SELECT asset_id AS k FROM production", "asset", "asset_id"),
    "fct_budget.plant_id": (f"SELECT plant_id AS k FROM ({_PLANTS})", "plant", "plant_id"),
    "agg_asset_hourly_health.asset_id": ("SELECT asset_id AS k FROM hourly", "asset", "asset_id"),
    "ml_feature_store.asset_id": ("SELECT asset_id AS k FROM (SELECT DISTINCT asset_id, d FROM telemetry)", "asset", "asset_id")}
SQL["dq_all_keys"] = " UNION ALL ".join(
    f"""SELECT '{n}' AS "check", count(*) AS rows, count(*) - count(DISTINCT k) AS violations FROM ({q})""" for n, q in _KEYS.items())
SQL["dq_all_references"] = " UNION ALL ".join(
    f"""SELECT '{n}' AS "check", count(k) AS rows, count(k) FILTER (k NOT IN (SELECT {key} FROM {parent})) AS violations FROM ({q})"""
    for n, (q, parent, key) in _REFERENCES.items())
#: The sample has no ids for production and budget rows, and no process or day key on these facts: named, not checked.
for _query, _names in {"dq_all_keys": ("fct_production_log", "fct_budget"),
                       "dq_all_references": ("fct_maintenance_log.process_id", "fct_production_log.process_id", "fct_production_log.date_sk")}.items():
    SQL[_query] += "".join(f" UNION ALL SELECT '{n}', NULL, NULL" for n in _names)
