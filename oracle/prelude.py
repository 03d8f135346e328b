"""Common table expressions that read the sample tables as the warehouse tables."""

from __future__ import annotations


def r(expr: str, digits: int = 2) -> str:
    """Round half away from zero in plain double arithmetic."""
    s = f"1e{digits}"
    x = f"CAST({expr} AS DOUBLE)"
    return f"(CASE WHEN abs({x}) * {s} < 9007199254740992e0 THEN sign({x}) * floor(abs({x}) * {s} + 0.5e0) / {s} ELSE {x} END)"


def div(n: str, d: str) -> str:
    """Guarded ratio: 0 where the base is not positive."""
    return f"(CASE WHEN ({d}) > 0 THEN CAST({n} AS DOUBLE) / CAST({d} AS DOUBLE) ELSE 0e0 END)"


TODAY = "DATE '2001-08-01'"
TELEMETRY_TODAY = "DATE '2024-01-30'"
TELEMETRY_NOW = "TIMESTAMP '2024-01-30 23:59:59'"

_SEG = ("CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 3 "
        "WHEN 'HOUSEHOLD' THEN 4 ELSE 5 END")
_HEALTH = "CAST(floor((100e0 - least(60e0, value / 4e0)) * 100e0 + 0.5e0) / 100e0 AS DECIMAL(5,2))"
_VIB = "CAST(CASE WHEN event_type = 'click' THEN value / 100e0 END AS DECIMAL(8,4))"

# Class, order type and failure code tables, as in plantpulse/sources/dimensions.py.
PRELUDE = f"""
asset_class(asset_class_id, class_name, process_type) AS (VALUES
  (1, 'AUTOMOBILE', 'Manufacturing'), (2, 'BUILDING', 'Assembly'), (3, 'FURNITURE', 'Testing'),
  (4, 'HOUSEHOLD', 'Manufacturing'), (5, 'MACHINERY', 'Assembly')),
wo_type(wo_type_id, wo_type_name, wo_type_code) AS (VALUES
  (1, 'Unplanned Emergency', 'UE'), (2, 'Planned Predictive', 'PP'), (3, 'Planned Preventive', 'PM'),
  (4, 'Inspection', 'INSP')),
failure_code(failure_code_id, h1, h2, h3) AS (VALUES
  (1, 'Mechanical', 'Bearing', 'Misalignment'), (2, 'Mechanical', 'Bearing', 'Lubrication'),
  (3, 'Mechanical', 'Seal', 'Wear'), (4, 'Mechanical', 'Coupling', 'Failure'),
  (5, 'Mechanical', 'Impeller', 'Erosion'), (6, 'Electrical', 'Motor', 'Winding'),
  (7, 'Electrical', 'Motor', 'Connection'), (8, 'Electrical', 'Sensor', 'Calibration'),
  (9, 'Electrical', 'Power Supply', 'Voltage'), (10, 'Operational', 'Overload', 'Capacity'),
  (11, 'Operational', 'Temperature', 'Overheating'), (12, 'Operational', 'Contamination', 'Foreign Object')),
plant AS (SELECT r_regionkey AS plant_id, r_name AS plant_name FROM region),
line AS (SELECT n_nationkey AS line_id, n_regionkey AS plant_id, n_name AS line_name,
  CAST(10000 + 500 * n_nationkey AS DECIMAL(10,2)) AS hourly_revenue FROM nation),
process AS (SELECT n_nationkey * 10 + asset_class_id AS process_id, n_name || ' ' || class_name AS process_name,
  process_type, n_nationkey AS line_id FROM nation, asset_class),
asset AS (SELECT c_custkey AS asset_id, 'eq_' || c_custkey AS asset_nk, c_name AS asset_name,
  'Model ' || (c_custkey % 20) AS model, 'OEM ' || (c_custkey % 8) AS oem_name,
  c_nationkey * 10 + {_SEG} AS process_id, c_custkey % 5 + 1 AS process_sequence, {_SEG} AS asset_class_id,
  DATE '2015-01-01' + CAST(c_custkey % 2500 AS INTEGER) AS installation_date,
  CAST(abs(c_acctbal) AS DECIMAL(12,2)) AS downtime_impact_per_hour,
  'site/' || c_nationkey || '/' || lower(c_mktsegment) || '/eq_' || c_custkey AS asset_path FROM customer),
placed AS (SELECT a.*, ac.class_name, pr.process_name, pr.process_type, l.line_id, l.line_name, l.hourly_revenue,
  p.plant_id, p.plant_name FROM asset a JOIN asset_class ac USING (asset_class_id)
  JOIN process pr ON pr.process_id = a.process_id JOIN line l ON l.line_id = pr.line_id
  JOIN plant p ON p.plant_id = l.plant_id),
machine AS (SELECT s_suppkey AS asset_id, s_name AS asset_name, s_nationkey * 10 + s_suppkey % 5 + 1 AS process_id
  FROM supplier),
machine_placed AS (SELECT m.asset_id, m.asset_name, pr.process_name, pr.process_type, l.line_name, l.hourly_revenue,
  p.plant_name FROM machine m JOIN process pr ON pr.process_id = m.process_id
  JOIN line l ON l.line_id = pr.line_id JOIN plant p ON p.plant_id = l.plant_id),
technician AS (SELECT s_suppkey AS technician_id, s_name AS technician_name,
  (['Mechanic', 'Electrician', 'Instrumentation'])[s_suppkey % 3 + 1] AS craft,
  (['Day', 'Evening', 'Night'])[s_suppkey % 7 % 3 + 1] AS shift FROM supplier),
material AS (SELECT p_partkey AS material_id, p_type || '-' || p_partkey AS material_nk, p_name AS material_desc,
  p_brand AS supplier_name, CAST(p_retailprice AS DECIMAL(10,2)) AS unit_cost FROM part),
production AS (SELECT l_suppkey AS asset_id, CAST(l_shipdate AS DATE) AS production_date,
  CAST(l_quantity AS DECIMAL(8,4)) AS planned, CAST(l_quantity * (1e0 - l_discount) AS DECIMAL(8,4)) AS actual,
  CAST(floor(l_extendedprice + 0.5e0) AS BIGINT) AS produced,
  CAST(floor(l_extendedprice * l_tax + 0.5e0) AS BIGINT) AS scrapped FROM lineitem),
maintenance AS (SELECT o_orderkey AS log_id, o_custkey AS asset_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE 4 END AS wo_type_id,
  CAST(o_orderdate AS DATE) AS completed_date, CAST(floor(o_totalprice / 1000e0) / 10e0 AS DECIMAL(5,1)) AS downtime_hours,
  CAST(o_totalprice AS DECIMAL(10,2)) - CAST(floor(o_totalprice * 40e0) / 100e0 AS DECIMAL(10,2)) AS parts_cost,
  CAST(floor(o_totalprice * 40e0) / 100e0 AS DECIMAL(10,2)) AS labor_cost,
  o_orderpriority = '1-URGENT' AS failure_flag, o_orderkey % 10 AS technician_id,
  CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey % 12 + 1 END AS failure_code_id,
  'Work order ' || o_orderkey || ' closed with status ' || o_orderstatus AS technician_notes FROM orders),
parts AS (SELECT l_orderkey AS log_id, l_partkey AS material_id, CAST(l_quantity AS DECIMAL(8,2)) AS quantity_used,
  CAST(l_extendedprice AS DECIMAL(10,2)) AS total_cost FROM lineitem),
telemetry AS (SELECT event_id AS telemetry_id, user_id AS asset_id, ts AS recorded_at, CAST(ts AS DATE) AS d,
  CAST(CASE WHEN event_type = 'view' THEN value END AS DECIMAL(6,2)) AS temperature_c, {_VIB} AS vibration_mm_s,
  CAST(CASE WHEN event_type = 'signup' THEN value + 100e0 END AS DECIMAL(6,2)) AS pressure_psi,
  {_HEALTH} AS health_score,
  CAST(floor(least(0.99e0, 0.01e0 + value / 300e0) * 100e0 + 0.5e0) / 100e0 AS DECIMAL(3,2)) AS failure_probability,
  1 + CAST(json_extract_string(props, '$.k') AS INTEGER) AS rul_days,
  ({_HEALTH} < 80 OR coalesce({_VIB} > 1.2, false)) AS is_anomalous FROM events),
service AS (SELECT event_id AS log_id, user_id AS asset_id,
  CASE event_type WHEN 'purchase' THEN 3 ELSE 1 END AS wo_type_id, CAST(ts AS DATE) AS completed_date,
  event_type = 'error' AS failure_flag FROM events WHERE event_type IN ('purchase', 'error')),
hourly AS (SELECT date_trunc('hour', recorded_at) AS hour_timestamp, asset_id,
  {r("CAST(sum(temperature_c) AS DOUBLE) / count(temperature_c)")} AS avg_temperature_c,
  {r("max(vibration_mm_s)")} AS max_vibration_mm_s, {r("stddev_samp(pressure_psi)")} AS stddev_pressure_psi,
  max(health_score) AS latest_health_score,
  CAST({r("CAST(sum(failure_probability) AS DOUBLE) / count(failure_probability)")} AS DECIMAL(3,2)) AS avg_failure_probability,
  min(rul_days) AS min_rul_days FROM telemetry GROUP BY 1, 2),
latest AS (SELECT * FROM hourly QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY hour_timestamp DESC) = 1)
"""
