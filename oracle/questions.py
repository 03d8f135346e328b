"""Analyst questions on telemetry, health and the feature store."""

from __future__ import annotations

from oracle.gold import LABEL, OBS, STORE
from oracle.prelude import TELEMETRY_NOW, TELEMETRY_TODAY, div, r

_MEAN_HEALTH = r("CAST(sum(latest_health_score) AS DOUBLE) / count(latest_health_score)", 4)
_30D = f"hour_timestamp BETWEEN {TELEMETRY_NOW} - INTERVAL 720 HOUR AND {TELEMETRY_NOW}"

SQL: dict[str, str] = {
    "health_by_oem": f""", x AS (SELECT oem_name, {_MEAN_HEALTH} AS avg_health FROM hourly JOIN asset USING (asset_id) WHERE {_30D} GROUP BY 1)
      SELECT *, row_number() OVER (ORDER BY avg_health DESC, oem_name) AS rank_no FROM x""",
    "weak_assets": """SELECT asset_id, CAST(latest_health_score AS DOUBLE) AS health, CAST(avg_failure_probability AS DOUBLE) AS probability FROM latest
      WHERE latest_health_score < (SELECT avg(latest_health_score) FROM latest) AND avg_failure_probability > (SELECT avg(avg_failure_probability) FROM latest)""",
    "health_trend_plant": f"""SELECT plant_name, CAST(hour_timestamp AS DATE) AS health_date, {_MEAN_HEALTH} AS avg_health
      FROM hourly JOIN placed USING (asset_id) WHERE plant_name = 'AMERICA' AND {_30D} GROUP BY 1, 2""",
    "health_by_plant": f"SELECT plant_name, {_MEAN_HEALTH} AS avg_health FROM hourly JOIN placed USING (asset_id) GROUP BY 1",
    "health_by_line": f"SELECT line_name, {_MEAN_HEALTH} AS avg_health FROM hourly JOIN placed USING (asset_id) GROUP BY 1",
    "flagged_assets": """, x AS (SELECT asset_id, recorded_at, is_anomalous FROM telemetry
        QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY recorded_at DESC, telemetry_id DESC) = 1)
      SELECT asset_id, recorded_at FROM x WHERE is_anomalous""",
    "lowest_life": "SELECT asset_id, min_rul_days FROM latest ORDER BY min_rul_days, asset_id LIMIT 1",
    "metric_summary": f"""SELECT {r(f'''CAST(sum(temperature_c) FILTER (recorded_at >= {TELEMETRY_NOW} - INTERVAL 24 HOUR) AS DOUBLE)
        / count(temperature_c) FILTER (recorded_at >= {TELEMETRY_NOW} - INTERVAL 24 HOUR)''', 4)} AS avg_temperature_24h,
      CAST(max(vibration_mm_s) AS DOUBLE) AS max_vibration_7d,
      {r("CAST(sum(pressure_psi) AS DOUBLE) / count(pressure_psi)", 4)} AS avg_pressure_7d FROM telemetry
      WHERE recorded_at BETWEEN {TELEMETRY_NOW} - INTERVAL 168 HOUR AND {TELEMETRY_NOW}""",
    "age_health_correlation": f"""SELECT count(*) AS assets, {r(f"corr(CAST(date_diff('day', installation_date, {TELEMETRY_TODAY}) AS DOUBLE), CAST(latest_health_score AS DOUBLE))", 4)} AS correlation
      FROM latest JOIN asset USING (asset_id)""",
    "vibration_trend": f"""SELECT d AS reading_date, {r("CAST(sum(vibration_mm_s) AS DOUBLE) / nullif(count(vibration_mm_s), 0)", 4)} AS avg_vibration
      FROM telemetry WHERE asset_id = 7 AND recorded_at BETWEEN {TELEMETRY_NOW} - INTERVAL 720 HOUR AND {TELEMETRY_NOW} GROUP BY 1""",
    "vibration_spread_of_class": f"""SELECT asset_id, {r("stddev_samp(vibration_mm_s)", 4)} AS vibration_stddev
      FROM telemetry JOIN placed USING (asset_id) WHERE class_name = 'MACHINERY' GROUP BY 1""",
    "risk_trend_slope": f""", d AS (SELECT asset_id, CAST(hour_timestamp AS DATE) AS d, CAST(sum(avg_failure_probability) AS DOUBLE) / count(*) AS y FROM hourly
        WHERE {_30D} GROUP BY 1, 2),
      s AS (SELECT asset_id, count(*) AS points, {r("regr_slope(y, CAST(date_diff('day', DATE '1970-01-01', d) AS DOUBLE))", 5)} AS slope FROM d GROUP BY 1)
      SELECT * FROM s WHERE slope > 0""",
    "probability_change": f""", x AS (SELECT CAST(sum(avg_failure_probability) FILTER (hour_timestamp < TIMESTAMP '2024-01-16') AS DOUBLE)
          / count(*) FILTER (hour_timestamp < TIMESTAMP '2024-01-16') AS a,
        CAST(sum(avg_failure_probability) FILTER (hour_timestamp >= TIMESTAMP '2024-01-16') AS DOUBLE)
          / count(*) FILTER (hour_timestamp >= TIMESTAMP '2024-01-16') AS b FROM hourly)
      SELECT {r("a", 6)} AS first_mean, {r("b", 6)} AS second_mean, {r("b - a", 6)} AS change FROM x""",
    "predicted_failures": f"""{OBS}, l AS ({LABEL}), z AS (SELECT * FROM l WHERE observation_date_sk <= 20240120 QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY observation_date_sk DESC) = 1)
      SELECT asset_id, observation_date_sk FROM z WHERE failed_in_next_7_days""",
    "impact_below_health": """SELECT count(*) AS assets, CAST(sum(downtime_impact_per_hour) AS DOUBLE) AS impact_per_hour
      FROM latest JOIN asset USING (asset_id) WHERE latest_health_score < 80""",
    "cycles_of_failed": f"""{STORE} SELECT count(*) AS observations, {r(div("sum(cycles_since_last_pm)", "count(*)"), 4)} AS mean_cycles
      FROM store WHERE failed_in_next_7_days""",
    "impact_risk_by_plant": f"""{STORE} SELECT plant_name, CAST(sum(CAST(downtime_impact_risk AS DECIMAL(16,2))) AS DOUBLE) AS impact_risk
      FROM store JOIN placed USING (asset_id) GROUP BY 1""",
    "vibration_outliers": f""", v AS (SELECT * FROM telemetry WHERE vibration_mm_s IS NOT NULL),
      p AS (SELECT a.telemetry_id, a.asset_id, a.recorded_at, CAST(a.vibration_mm_s AS DOUBLE) AS v,
        CAST(sum(b.vibration_mm_s) AS DOUBLE) / count(*) AS m, stddev_samp(b.vibration_mm_s) AS s
        FROM v a JOIN v b ON a.asset_id = b.asset_id AND b.d BETWEEN a.d - 7 AND a.d - 1 GROUP BY 1, 2, 3, 4)
      SELECT telemetry_id, asset_id, recorded_at, v AS vibration_mm_s, {r("m", 4)} AS past_mean, {r("s", 4)} AS past_std
      FROM p WHERE abs(v - m) > s * 2""",
    "star_join_maintenance": """SELECT plant_name, class_name, wo_type_name, craft, count(*) AS orders, CAST(sum(parts_cost + labor_cost) AS DOUBLE) AS total_cost
      FROM maintenance JOIN placed USING (asset_id) JOIN wo_type USING (wo_type_id) JOIN technician USING (technician_id) GROUP BY 1, 2, 3, 4""",
    "result_top10": """SELECT asset_id, CAST(latest_health_score AS DOUBLE) AS health, greatest((SELECT count(*) FROM latest) - 10, 0) AS rows_not_shown
      FROM latest ORDER BY latest_health_score, asset_id LIMIT 10""",
}
